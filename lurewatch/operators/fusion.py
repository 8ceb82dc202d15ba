"""Signals -> risk, reasons, advice, assessment. Signals sit in one bounded array per mail, so every step is
a map over rows without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch import wording
from lurewatch.functions.domains import let


def strongest(signals: Column, category: str) -> Column:
    """The highest severity in a category; 0 without one."""
    own = F.transform(F.filter(signals, lambda s: s["category"] == category), lambda s: s["severity"])
    return F.coalesce(F.array_max(own), F.lit(0))


def strongest_by_category(long_signals: DataFrame) -> DataFrame:
    return long_signals.groupBy("message_id", "category").agg(F.max("severity").alias("severity"))


def points(severity: Column) -> Column:
    value = F.lit(0)
    for level, weight in lists.SEVERITY_POINTS.items():
        value = F.when(severity == level, weight).otherwise(value)
    return value


def score(signals: Column) -> Column:
    categories = F.array_distinct(F.transform(signals, lambda s: s["category"]))
    per_category = F.transform(categories, lambda c: points(F.array_max(F.transform(
        F.filter(signals, lambda s: s["category"] == c), lambda s: s["severity"]))))
    return F.aggregate(per_category, F.lit(0), lambda a, b: a + b)


def floors(signals: Column) -> list[tuple[str, Column]]:
    """Named combinations that are at least HIGH on their own."""

    def at_least(category: str, level: int) -> Column:
        return F.exists(signals, lambda s: (s["category"] == category) & (s["severity"] >= level))

    def impersonated(extra: list[str]) -> Column:
        return F.exists(signals, lambda s: s["category"].isin([*lists.IMPERSONATION, *extra]) & (s["severity"] >= 2))

    return [
        (wording.FLOOR_RULES["credential"], at_least("credential_request", 2) & impersonated([])),
        (wording.FLOOR_RULES["known_bad"], at_least("known_bad", 3)),
        (wording.FLOOR_RULES["mfa"], at_least("mfa_code_request", 3)),
        (wording.FLOOR_RULES["gift_card"], at_least("gift_card", 2) & at_least("colleague_impersonation", 2)),
        (wording.FLOOR_RULES["payment"],
         at_least("payment_change", 2) & impersonated(["reply_to_mismatch", "return_path_mismatch"])),
    ]


def fuse(messages: DataFrame) -> DataFrame:
    """Adds score, risk (0..2) and the floor and cap rules that fired. A mail alone is never CRITICAL."""
    signals = F.col("signals")
    fired = F.filter(F.array(*[F.when(test, name) for name, test in floors(signals)]), lambda r: r.isNotNull())
    moderate = F.exists(signals, lambda s: (s["severity"] >= 2) & (s["source"] != "ml"))
    scored = messages.withColumns({"score": score(signals), "fired": fired, "moderate": moderate})
    by_points = F.when(F.col("score") >= lists.HIGH_AT, 2).when(F.col("score") >= lists.MEDIUM_AT, 1).otherwise(0)
    raised = F.greatest(by_points, F.when(F.size("fired") > 0, 2).otherwise(0))
    capped = (raised >= 2) & ~F.col("moderate")
    return scored.withColumns({
        "risk": F.when(capped, 1).otherwise(raised),
        "rules_fired": F.when(capped, F.array_append("fired", F.lit(wording.CAP_RULE))).otherwise(F.col("fired")),
    }).drop("fired", "moderate")


def in_fusion_order(signals: Column) -> Column:
    """Severity down, classifier last, then category and rule id as text."""
    keyed = F.transform(signals, lambda s: F.struct(
        (-s["severity"]).alias("a"), (s["source"] == "ml").alias("b"), s["category"].alias("c"), s["rule_id"].alias("d"), s.alias("s")
    ))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def reasons(signals: Column) -> Column:
    """One sentence per category, its strongest signal, strongest first, at most five."""

    def first_per_category(ordered: Column) -> Column:
        kept = F.filter(
            F.transform(ordered, lambda s, i: F.struct(s.alias("s"), i.alias("i"))),
            lambda x: (x["s"]["severity"] > 0) & ~F.exists(
                F.slice(ordered, F.lit(1), x["i"]), lambda e: (e["category"] == x["s"]["category"]) & (e["severity"] > 0)
            ),
        )
        return F.slice(F.transform(kept, lambda x: x["s"]["evidence"]), 1, lists.MAX_REASONS)

    return let(in_fusion_order(signals), first_per_category)


def recommended_action(risk: Column, signals: Column) -> Column:
    base = F.get(F.array(*map(F.lit, wording.BASE_ACTION)), risk)
    specific = F.filter(
        F.array(*[
            F.when(_has(signals, category), advice)
            for category, advice in wording.SPECIFIC_ACTION
        ]),
        lambda a: a.isNotNull(),
    )
    return F.when(risk < 2, base).otherwise(F.array_join(F.concat(F.slice(specific, 1, 2), F.array(base)), " "))


def _has(signals: Column, category: str) -> Column:
    return F.exists(signals, lambda s: (s["category"] == category) & (s["severity"] >= 2))


def uncertainties(unchecked: Column, probability: Column) -> Column:
    note = F.when(probability.isNull(), wording.ML_MISSING).when(
        probability.between(lists.UNSURE_LOW, lists.UNSURE_HIGH), wording.ML_UNSURE
    )
    return F.concat(unchecked, F.filter(F.array(note), lambda n: n.isNotNull()))


def ml_signal(probability: Column, fallback_model: bool) -> Column:
    """The classifier's signal; the fallback model only ever counts as weak."""
    strong = (probability >= lists.ML_STRONG) & F.lit(not fallback_model)
    return F.when(probability >= lists.ML_MODERATE, F.struct(
        F.lit("ml.text").alias("rule_id"), F.lit("ml_phishing").alias("category"),
        F.when(strong, 2).otherwise(1).alias("severity"),
        F.when(strong, wording.ML_STRONG).otherwise(wording.ML_WEAK).alias("evidence"), F.lit("ml").alias("source"),
    ))


def assess(detected: DataFrame, probability: Column | None = None, fallback_model: bool = False) -> DataFrame:
    """The full assessment row per mail. Without a probability the rules stand alone."""
    probability = F.lit(None).cast("double") if probability is None else probability
    with_ml = F.filter(
        F.concat("signals", F.array(ml_signal(probability, fallback_model))), lambda s: s.isNotNull()
    )
    rows = fuse(detected.withColumns({"ml_confidence": F.round(probability, 4), "signals": with_ml}))
    return rows.select(
        "message_id", "recipient_id", "received_at", "risk", "score", in_fusion_order(F.col("signals")).alias("signals"),
        "rules_fired", "ml_confidence",
        uncertainties(F.col("unchecked"), probability).alias("uncertainties"),
        F.get(F.array(*map(F.lit, wording.SUMMARY)), F.col("risk")).alias("summary"),
        reasons(F.col("signals")).alias("reasons"),
        recommended_action(F.col("risk"), F.col("signals")).alias("recommended_action"),
    )
