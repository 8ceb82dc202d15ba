"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language. An unseen word is scored by the longest
character n-grams that the model knows: from each position the longest known n-gram is taken, falling back one character
at a time. A text's score per language is the sum over its words; the prediction is the best language and its posterior.

The model is fitted on a bounded sample of labelled rows: about ``SAMPLE_ROWS`` rows of each language, chosen by a hash of
the id, whole texts. It keeps the ``WORDS`` most frequent words and ``GRAMS`` most frequent n-grams per order and
language, so its size is bounded by the number of languages. Prediction is one narrow pass over all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be learned
from. Languages that tie go to the smaller name. Repeated rows get a result each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import give_back, learned_from, most_frequent

#: Bounds of the fitted model, all per language: rows learned from, words and n-grams of each order that are kept.
SAMPLE_ROWS, WORDS, GRAMS = 4000, 30_000, 20_000
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Backing off one character costs this factor.
BACKOFF = math.log(0.4)
CACHE = 50_000
_RUNS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    return _RUNS.findall(text.lower())


def bare(word: str) -> str:
    """The letters of a word: the pattern above also lets some number signs through."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch["lang"], batch["text"]):
            counts[lang].update(map(bare, letter_words(text)))
        rows = [(lang, word, n) for lang, own in counts.items() for word, n in own.items() if word]
        yield pd.DataFrame(rows, columns=["lang", "gram", "n"])


def split_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, word, n) -> (lang, order, gram, n): n-grams of the word between boundary marks."""
    for batch in batches:
        counts: dict[tuple, int] = defaultdict(int)
        for lang, word, n in zip(batch["lang"], batch["gram"], batch["n"]):
            marked = f"^{word}$"
            for order in ORDERS:
                for i in range(len(marked) - order + 1):
                    counts[lang, order, marked[i : i + order]] += n
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "order", "gram", "n"])


@dataclass
class Rows:
    """A row of log probabilities for each item, in one matrix: a model of small arrays would take several times the memory."""

    place: dict[str, int]
    values: np.ndarray

    def get(self, item: str) -> np.ndarray | None:
        at = self.place.get(item)
        return None if at is None else self.values[at]

    def with_rows(self, other: "Rows") -> "Rows":
        return Rows(self.place | {k: len(self.values) + i for k, i in other.place.items()}, np.concatenate([self.values, other.values]))


@dataclass
class Model:
    """languages in order; word and n-gram rows of log probabilities; what an unseen single character scores."""

    languages: list[str]
    words: Rows
    grams: Rows
    floor: np.ndarray


def _table(rows: list, languages: list[str]) -> tuple[Rows, np.ndarray]:
    """Add-one smoothed log probabilities of each item in each language."""
    column, place = {name: i for i, name in enumerate(languages)}, {}
    for _, gram, _, _ in rows:
        place.setdefault(gram, len(place))
    totals, counts = np.ones(len(languages)), np.zeros((len(place), len(languages)))
    for lang, gram, n, total in rows:
        counts[place[gram], column[lang]] = n
        totals[column[lang]] = total
    norm = np.log(totals + len(place) + 1)
    return Rows(place, np.log(counts + 1) - norm), -norm


def fit(labelled: DataFrame, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """labelled: key, text, lang. Rows without a language or text teach nothing."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return Model([], Rows({}, np.zeros((0, 0))), Rows({}, np.zeros((0, 0))), np.zeros(0))
    # xxhash64 spreads ids over 2**64: a row is in the sample if its hash falls into the share that gives sample_rows.
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample_rows / n))])
    picked = (F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(1 << 30)) < share[F.col("lang")]
    counted = (rows.where(picked).select("lang", "text").mapInPandas(count_words, "lang string, gram string, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n"))).cache()
    grams = counted.mapInPandas(split_words, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(
        F.sum("n").alias("n")).cache()
    languages = sorted(sizes)
    word_total = {(r[0],): r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    gram_total = {(r[0], r[1]): r[2] for r in grams.groupBy("lang", "order").agg(F.sum("n")).collect()}
    words = [(*r, word_total[r[0],]) for r in most_frequent(counted, ["lang"], "gram", WORDS).select("lang", "gram", "n").collect()]
    kept = [(*r, gram_total[r[0], r[1]]) for r in most_frequent(grams, ["lang", "order"], "gram", GRAMS).select("lang", "order", "gram", "n").collect()]
    counted.unpersist()
    grams.unpersist()
    tables, floor = Rows({}, np.zeros((0, len(languages)))), np.zeros(len(languages))
    for order in ORDERS:
        own, low = _table([(lang, gram, n, total) for lang, o, gram, n, total in kept if o == order], languages)
        tables = tables.with_rows(own)
        floor = low
    return Model(languages, _table(words, languages)[0], tables, floor)


class Scorer:
    """Scores words in one Python worker; remembers words that it has backed off for, up to CACHE of them."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        self.none = np.zeros(len(model.languages))

    def word(self, word: str) -> np.ndarray:
        word = bare(word)
        if not word:
            return self.none
        known = self.model.words.get(word)
        return known if known is not None else self.backed_off(f"^{word}$")

    def backed_off(self, marked: str) -> np.ndarray:
        grams, top, total, i, n = self.model.grams, ORDERS[0], self.none.copy(), 0, len(marked)
        while i < n:
            for order in range(min(top, n - i), 0, -1):
                found = grams.get(marked[i : i + order])
                if found is not None:
                    total += found + (top - order) * BACKOFF
                    i += order
                    break
            else:
                total += self.model.floor + top * BACKOFF
                i += 1
        return total

    def text(self, text: str | None) -> tuple[str, float]:
        counts = Counter(letter_words(text)) if text else None
        if not counts or not self.model.languages or not any(map(bare, counts)):
            return UNKNOWN, 0.0
        seen, rows = self.seen, []
        for word in counts:
            row = seen.get(word)
            if row is None:
                if len(seen) >= CACHE:
                    seen.clear()
                row = seen[word] = self.word(word)
            rows.append(row)
        scores = np.fromiter(counts.values(), dtype=float, count=len(rows)) @ np.array(rows)
        best = int(scores.argmax())
        return self.model.languages[best], float(1 / np.exp(np.maximum(scores - scores[best], -700)).sum())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added, in one pass; nothing but the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages
    scorers: dict[int, Scorer] = {}

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorers.setdefault(0, Scorer(held.value))
        for batch in texts:
            yield pd.DataFrame([scorer.text(x) for x in batch], columns=["lang_pred", "score"])
        give_back()

    found = F.pandas_udf(scored, "lang_pred string, score double")(F.col(text))
    return docs.withColumn("__found", found).select("*", "__found.lang_pred", "__found.score").drop("__found")


def held_out(key: str = "doc_id") -> Column:
    return ~learned_from(F.col(key), 4)


def digest(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text", "lang")
    model = fit(own.where(~held_out()))
    return predict(own.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
