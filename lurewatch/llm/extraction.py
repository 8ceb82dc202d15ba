"""The main text of web pages by a linear-chain conditional random field over leaf blocks.

A block's features are its ancestors' tags and the hints in their class, id and role names, its size, links, punctuation
and cue words. Two labels, article or not; a weight per feature and a score per pair of neighbouring labels. The weights
maximise the penalised likelihood of ``TRAINING_PAGES`` labelled pages (see labelled_pages), a bound that does not depend on
the input, so fitting is a matter of a second on the driver. Viterbi decodes each page in one narrow pass over whole pages.

Defined results: a null or empty page, or one without article blocks, has the empty text. Repeated rows get a result each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.blocks import Block, blocks
from lurewatch.llm.labelled_pages import pages

TRAINING_PAGES, STEPS, RATE, PENALTY = 600, 150, 0.15, 1e-4


@dataclass
class Field:
    """weights: score of label 1 for each feature; pairs[a, b]: score of label b after label a."""

    weights: dict[str, float]
    pairs: np.ndarray

    def labels(self, own: list[Block]) -> list[int]:
        """The most likely labels of a page's blocks."""
        (stay0, to1), (to0, stay1) = self.pairs.tolist()
        weights, back, s0, s1 = self.weights, [], 0.0, 0.0
        for n, block in enumerate(own):
            score = 0.0
            for name in block.features:
                score += weights.get(name, 0.0)
            if n == 0:
                s0, s1 = 0.0, score
                continue
            from0, from1 = s0 + stay0 >= s1 + to0, s0 + to1 > s1 + stay1
            back.append((0 if from0 else 1, 0 if from1 else 1))
            s0, s1 = (s0 + stay0 if from0 else s1 + to0), (s0 + to1 if from1 else s1 + stay1) + score
        if not own:
            return []
        out = [1 if s1 > s0 else 0]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        own = blocks(page)
        return " ".join(block.text for block, label in zip(own, self.labels(own)) if label)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def fit(labelled: list[list[Block]], steps: int = STEPS) -> Field:
    """Adam on the penalised log-likelihood; forward and backward sums run over all pages side by side."""
    labelled = sorted((p for p in labelled if p), key=len, reverse=True)
    names = {name: i for i, name in enumerate(sorted({f for p in labelled for b in p for f in b.features}))}
    count, longest = len(labelled), len(labelled[0])
    x, y = np.zeros((count, longest, len(names)), np.float32), np.zeros((count, longest), np.int64)
    for i, own in enumerate(labelled):
        for t, block in enumerate(own):
            x[i, t, [names[f] for f in block.features]] = 1
            y[i, t] = block.gold == "1"
    sizes = np.array([len(p) for p in labelled])
    there = np.arange(longest)[None, :] < sizes[:, None]
    active = [int((sizes > t).sum()) for t in range(longest)]
    total = float(there.sum())
    theta = np.zeros(len(names) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    flat, real = x[there], np.nonzero(there)
    seen = flat.T @ y[real].astype(np.float32)
    pairs_seen = np.zeros((2, 2))
    np.add.at(pairs_seen, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
    for step in range(1, steps + 1):
        weights, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        emit = np.zeros((count, longest, 2))
        emit[:, :, 1][real] = flat @ weights.astype(np.float32)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            n = active[t]
            ahead[:n, t] = emit[:n, t] + _logsum(ahead[:n, t - 1, :, None] + pairs[None], 1)
        for t in range(longest - 2, -1, -1):
            n = active[t + 1]
            behind[:n, t] = _logsum(pairs[None] + (emit[:n, t + 1] + behind[:n, t + 1])[:, None, :], 2)
        norm = _logsum(ahead[np.arange(count), sizes - 1], 1)
        marginal = np.exp(ahead + behind - norm[:, None, None])[:, :, 1] * there
        gradient = np.zeros_like(theta)
        gradient[:-4] = seen - flat.T @ marginal[real].astype(np.float32)
        joint = np.exp(np.minimum(0, ahead[:, :-1, :, None] + pairs[None, None] + (emit + behind)[:, 1:, None, :] - norm[:, None, None, None]))
        gradient[-4:] = (pairs_seen - (joint * there[:, 1:, None, None]).sum(axis=(0, 1))).ravel()
        gradient = gradient / total - PENALTY * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field({name: float(theta[i]) for name, i in names.items()}, theta[-4:].reshape(2, 2).copy())


@lru_cache(maxsize=4)
def trained(count: int = TRAINING_PAGES) -> Field:
    return fit([blocks(p) for p in pages(count)])


def extract(pages_table: DataFrame, html: str = "html", model: Field | None = None) -> DataFrame:
    """The rows with the main text added as column ``main_text``."""
    held = pages_table.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(held.value.text, na_action=None).astype(object)

    return pages_table.withColumn("main_text", F.pandas_udf(run, "string")(F.col(html)))


def digest(pages_table: DataFrame) -> DataFrame:
    found = extract(pages_table.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
