"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns
estimates how often each rule is right on good and on bad documents; the posterior probability of "good" then
replaces all-must-pass filtering. There are at most 3 ** len(RULES) vote patterns whatever the corpus, so only that
bounded table of counts reaches the driver.

Defined results: a null or empty text has no words and fails the base rule; repeated rows each get their own result;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import let, stored, words_of

SYMBOLS = "#*$%&|<>"
# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in that is was for with a it this "
    "le la les des une est que dans pour sur de et un en "
    "der die das und von mit auf für ist ein eine zu den "
    "el los las que por una con del su y se es").split()
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ROUNDS, THRESHOLD = 60, 0.5
PRIOR_GOOD, PRIOR_RIGHT, PRIOR_WEIGHT = 0.8, 0.8, 4.0


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: the windows are sorted by hash with their positions, equal
    neighbours are kept, and the covered positions are counted in order."""

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            positions, start,
            lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total")),
            lambda acc: acc["total"])

    def repeated(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(ordered, lambda s: covered(F.sort_array(F.filter(
            F.transform(s, lambda x, i: F.when(
                (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull()))))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    hashed = F.when(F.size(words) >= 3, let(words, windows)).otherwise(F.array().cast("array<bigint>"))
    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))).cast("long")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and the measured quantities of each whole text; one narrow pass, no shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key), body.alias("body"), words_of(F.col(text)).alias("words"))
    return base.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines_of(F.col("body")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(lines_of(F.col("body"))).alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop"),
        F.regexp_count("body", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).alias("n_bare"),
        F.length(F.regexp_replace("body", r"[^\p{L}]+", "")).alias("n_letters"),
    )


def lines_of(body: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, else abstains (also where a condition is null)."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "n_words > 0 AND n_symbols <= 0.02 * n_words", "n_symbols > 0.10 * n_words"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND n_dup_lines = 0", "n_dup_lines > 0.3 * n_lines"),
    Rule("repeated_windows", "n_words >= 50 AND n_repeat_words <= 0.15 * n_words", "n_repeat_words > 0.3 * n_words"),
    Rule("function_words", "n_words >= 20 AND n_stop >= 0.08 * n_words", "n_words >= 30 AND n_stop < 0.03 * n_words"),
    Rule("letters", "n_letters >= 0.85 * word_chars AND n_words > 0", "n_letters < 0.70 * word_chars"),
    Rule("bare_symbols", "n_words > 0 AND n_bare <= 0.08 * n_words", "n_bare > 0.2 * n_words"),
    Rule("vocabulary", "n_words >= 50 AND n_distinct >= 0.3 * n_words", "n_words >= 50 AND n_words < 1000 AND n_distinct < 0.2 * n_words"),
)


def votes(measured: DataFrame) -> DataFrame:
    """Adds one int column per rule: 1 good, -1 bad, 0 abstains."""
    return measured.select("*", *[
        F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END").alias(f"vote_{r.name}") for r in RULES])


@dataclass(frozen=True)
class Accuracies:
    """P(good), and per rule how often its vote is right on good and on bad documents."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weight(self, rule: int, vote: int) -> float:
        """Log-odds that a vote adds for "good"."""
        g, b = self.on_good[rule], self.on_bad[rule]
        return math.log(g / (1 - b)) if vote > 0 else math.log((1 - g) / b) if vote < 0 else 0.0

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = math.log(self.good / (1 - self.good)) + sum(self.weight(j, v) for j, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over (vote pattern, number of documents). The starting values, that rules are right more
    often than not, also serve as a prior worth PRIOR_WEIGHT documents; so an empty corpus keeps them."""
    k = len(RULES)
    model = Accuracies(PRIOR_GOOD, (PRIOR_RIGHT,) * k, (PRIOR_RIGHT,) * k)
    for _ in range(rounds):
        weighed = [(p, n * (q := model.posterior(p)), n * (1 - q)) for p, n in patterns]
        good, bad = sum(g for _, g, _ in weighed), sum(b for _, _, b in weighed)
        on_good, on_bad = [], []
        for j in range(k):
            right = PRIOR_WEIGHT * PRIOR_RIGHT
            on_good.append((right + sum(g for p, g, _ in weighed if p[j] > 0)) / (PRIOR_WEIGHT + sum(g for p, g, _ in weighed if p[j])))
            on_bad.append((right + sum(b for p, _, b in weighed if p[j] < 0)) / (PRIOR_WEIGHT + sum(b for p, _, b in weighed if p[j])))
        share = (PRIOR_WEIGHT * PRIOR_GOOD + good) / (PRIOR_WEIGHT + good + bad)
        # A rule that is worse than chance on a class would turn the classes round; it counts as chance there.
        hold = lambda x: min(1 - 1e-6, max(0.5, x))
        model = Accuracies(min(1 - 1e-6, max(1e-6, share)), tuple(map(hold, on_good)), tuple(map(hold, on_bad)))
    return model


def learn(voted: DataFrame) -> Accuracies:
    names = [f"vote_{r.name}" for r in RULES]
    counted = voted.groupBy(*names).count().collect()  # 3 ** len(RULES) rows at most
    return fit([(tuple(row[n] for n in names), row["count"]) for row in counted])


def probability(model: Accuracies) -> Column:
    """The posterior probability of "good" from the vote columns."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for j, r in enumerate(RULES):
        vote = F.col(f"vote_{r.name}")
        odds = odds + F.when(vote > 0, model.weight(j, 1)).when(vote < 0, model.weight(j, -1)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, measures, votes and the posterior ``p_good`` of every document."""
    voted = stored(votes(measures(docs, key, text)), "quality")
    return voted.withColumn("p_good", probability(learn(voted)))


def digest(docs: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("p_good") >= THRESHOLD)).alias("kept"), "p_good")
