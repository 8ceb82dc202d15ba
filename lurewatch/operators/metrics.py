"""Classifier quality from (score, label) rows. Equal scores are summed first; running sums go over score
bins, so no window ever holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1000


def _by_score(scored: DataFrame) -> DataFrame:
    """(score, pos, neg, pos_below, neg_below) per distinct score."""
    counts = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    counts = counts.withColumn("bin", F.floor(F.col("score") * BINS))
    over_bins = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 1001 rows
    bins = counts.groupBy("bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "bin", F.coalesce(F.sum("p").over(over_bins), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(over_bins), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(bins, "bin").select(
        "score", "pos", "neg",
        (F.col("p0") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_below"),
        (F.col("n0") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_below"))


def roc_auc(scored: DataFrame) -> DataFrame:
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return _by_score(scored).agg((wins / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    totals = F.struct(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    all_rows = scored.agg(totals.alias("t"))
    above_pos, above_neg = F.col("t.p") - F.col("pos_below"), F.col("t.n") - F.col("neg_below")
    step = F.col("pos") / F.col("t.p") * above_pos / (above_pos + above_neg)
    return _by_score(scored).withColumn("one", F.lit(1)).join(all_rows.withColumn("one", F.lit(1)), "one").agg(F.sum(step).alias("pr_auc"))


def ece(scored: DataFrame, bins: int = 15) -> DataFrame:
    bucket = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = scored.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("p"), F.avg("label").alias("y"))
    return per.agg((F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / F.sum("n")).alias("ece"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    return scored.agg(F.count_if(~yes & ~pos).alias("tn"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(yes & pos).alias("tp"))


def temperature(logits: DataFrame, grid: list[float]) -> DataFrame:
    """The grid value with the least mean log loss of (logit, label) rows."""
    t = F.explode(F.array(*map(F.lit, grid)))
    z = F.col("logit") / F.col("t")
    # log(1 + e^x) without overflow
    soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    losses = logits.withColumn("t", t).groupBy("t").agg(F.avg(soft - F.col("label") * z).alias("loss"))
    return losses.agg(F.min_by("t", F.struct(F.round("loss", 12), "t")).alias("temperature"))
