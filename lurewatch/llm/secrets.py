"""Secret scans: fixed patterns, and a guess-cost dynamic program over values that stand in a credential context.

A value after a credential word, after "Bearer" or in the user part of a URL is split at minimum cost into dictionary words,
dates, repeats, keyboard walks and brute-force spans; the cost is the decimal logarithm of the guesses. Values that
cost ``MIN_LOG_GUESSES`` or more are reported as kind ``guess``, besides the fixed kinds, which stay whatever they cost.

The scan is one narrow pass over whole texts. The word ranks come from a public tokenizer's vocabulary, whose path is a
parameter; its fixed size bounds the broadcast. Costs are linear in the length of a value.

Defined results: a null or empty text has no spans; repeated rows get a result each; an empty table gives an empty
result; other columns pass through or are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
MIN_LOG_GUESSES = 8.0
KINDS = ("assign", "access", "hex", "guess")
SPAN = "struct<kind:string, start:int, end:int, secret_start:int, log_guesses:double>"

# The patterns of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BETWEEN = r"[\x20\t\r\n]*"
_CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|client[_-]?secret|credentials?|(?<![a-z])pin)["']?"""
    rf"""(?:{_BETWEEN}(?::=|=>|[:=]){_BETWEEN}|[\x20\t]+is[\x20\t]+)"""
    r"""(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"'<>]{5,}[^\s"'<>.,;:!?)\]}]))"""
    r"""|(?<![a-z])bearer\x20+([A-Za-z0-9+/_.=~-]{6,})"""
    r"""|://[^\s/:@]*:([^\s/@]{6,})@)""", re.I | re.A)
_DATES = re.compile(r"(?=((?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d))")
_YEARS = re.compile(r"(?=((?:19|20)\d\d))")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

LONGEST_WORD, LONGEST_BLOCK, JOIN_COST = 24, 8, 0.3
_NEIGHBOURS = {(row[i], row[i + 1]): 1 for row in _ROWS for i in range(len(row) - 1)} | {
    (row[i + 1], row[i]): -1 for row in _ROWS for i in range(len(row) - 1)}


def word_ranks(vocabulary: str = VOCABULARY) -> dict[str, float]:
    """Word -> log10 of its rank in the vocabulary, for words of three letters or more."""
    with open(vocabulary, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    words = sorted((i, w.removesuffix("</w>")) for w, i in ids.items())
    ranks: dict[str, float] = {}
    for _, word in words:
        if len(word) >= 3 and word.isalpha() and word not in ranks:
            ranks[word] = math.log10(len(ranks) + 2)
    return ranks


def _char_cost(char: str) -> float:
    return 1.0 if char.isdigit() else math.log10(26) if char.isalpha() and char.isascii() else math.log10(33) if char.isascii() else 3.0


def _walks(lower: str) -> Iterator[tuple[int, int, float]]:
    """Maximal runs of three or more keys that go one way along a keyboard row or the alphabet."""
    i = 0
    while i < len(lower) - 1:
        way, j = _NEIGHBOURS.get((lower[i], lower[i + 1])), i + 1
        if way is None:
            i += 1
            continue
        while j < len(lower) - 1 and _NEIGHBOURS.get((lower[j], lower[j + 1])) == way:
            j += 1
        if j - i >= 2:
            yield i, j + 1, math.log10(2 * 40 * (j + 1 - i))
        i = j


def _repeats(value: str, ranks: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """Maximal runs of a block of up to LONGEST_BLOCK characters; a run costs one block and the number of its repeats."""
    n = len(value)
    for size in range(1, min(LONGEST_BLOCK, n // 2) + 1):
        i = 0
        while i + size < n:
            j = i
            while j + size < n and value[j] == value[j + size]:
                j += 1
            times = (j - i) // size + 1
            if j > i and times >= (3 if size == 1 else 2):
                yield i, i + times * size, _least(value[i : i + size], ranks, repeats=False) + math.log10(times)
            i = j + 1


def _least(value: str, ranks: dict[str, float], repeats: bool = True) -> float:
    n, lower = len(value), value.lower()
    if len(lower) != n:  # a few letters change length; they are never in the word list
        lower = value
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n - 2):
        if lower[i].isalpha():
            for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
                rank = ranks.get(lower[i:j])
                if rank is not None:
                    plain = value[i:j]
                    ends[j].append((i, rank + (0.0 if plain == lower[i:j] else 0.3 if plain.istitle() or plain.isupper() else 1.0)))
    for m in _DATES.finditer(value):
        ends[m.end(1)].append((m.start(1), math.log10(365 * 200) + (0 if m[1].isdigit() else 0.6)))
    for m in _YEARS.finditer(value):
        ends[m.end(1)].append((m.start(1), math.log10(200)))
    for i, j, cost in _walks(lower):
        ends[j].append((i, cost))
    if repeats:
        for i, j, cost in _repeats(value, ranks):
            ends[j].append((i, cost))
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        least = best[j - 1] + _char_cost(value[j - 1])
        for i, cost in ends[j]:
            least = min(least, best[i] + cost + JOIN_COST)
        best[j] = least
    return best[n]


def log_guesses(value: str, ranks: dict[str, float]) -> float:
    """The decimal logarithm of the guesses that the cheapest segmentation of a value needs."""
    return _least(value, ranks)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    secret_start: int
    log_guesses: float


def find(text: str | None, ranks: dict[str, float], least: float = MIN_LOG_GUESSES) -> list[Span]:
    """All spans of a text by start, then kind as listed in KINDS."""
    if not text:
        return []
    spans = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            spans.append(Span("assign", m.start(), m.end(), m.start(2), log_guesses(m[2], ranks)))
    # {16,} and {24,} give what dropping the shorter matches gives: both classes match whole runs.
    spans += [Span("access", m.start(), m.end(), m.start(), log_guesses(m[0], ranks)) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [Span("hex", m.start(), m.end(), m.start(), log_guesses(m[0], ranks)) for m in _HEX.finditer(text)]
    for m in _CONTEXT.finditer(text):
        group = m.lastindex
        start, end = m.span(group)
        if any(s.secret_start <= start and end <= s.end for s in spans):
            continue
        cost = log_guesses(m[group], ranks)
        if cost >= least:
            spans.append(Span("guess", start, end, start, cost))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def hidden(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every secret (of an assignment only its value) replaced by a mark; overlapping ones by one mark."""
    out, at = [], 0
    for start, end in sorted((s.secret_start, s.end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scanned(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, least: float = MIN_LOG_GUESSES) -> Column:
    """struct(spans, n_assign, n_access, n_hex, base_sha256, listed, clean): what a text holds, and the text without it."""
    ranks = spark.sparkContext.broadcast(word_ranks(vocabulary))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for x in batch:
                spans = find(x, ranks.value, least)
                base = [s for s in spans if s.kind != "guess"]
                count = {k: sum(s.kind == k for s in base) for k in KINDS[:3]}
                rows.append(([vars(s) for s in spans], count["assign"], count["access"], count["hex"],
                             hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), hidden(x, spans) if spans else x))
            yield pd.DataFrame(rows, columns=["spans", "n_assign", "n_access", "n_hex", "base_sha256", "listed", "clean"])

    return F.pandas_udf(
        run, f"spans array<{SPAN}>, n_assign long, n_access long, n_hex long, base_sha256 string, listed string, clean string")(text)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Key and what its text holds."""
    own = docs.select(F.col(key), scanned(docs.sparkSession, F.col(text), vocabulary).alias("__found"))
    return own.select(key, "__found.*")


def redact(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The same rows and columns, without the secrets; n_chars is counted anew where there was one."""
    names = docs.columns
    out = docs.withColumn("__found", scanned(docs.sparkSession, F.col(text), vocabulary))
    changed = F.size("__found.spans") > 0
    values = {text: F.col("__found.clean").alias(text)}
    if "n_chars" in names:
        values["n_chars"] = F.when(changed, F.length("__found.clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[values.get(n, F.col(f"`{n}`")) for n in names])


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("listed").alias("spans"))
