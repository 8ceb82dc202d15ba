"""The latest earlier row per key, safe for hot keys.

Time is cut into buckets. Inside a (key, bucket) a window finds the latest earlier row; over buckets only one
aggregated row per (key, bucket) is carried forward. So one key's whole history never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, bucket_seconds: int = 21600) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row of the same keys at or before ``ts``.

    Both sides hold the keys and ``ts``; ``left`` must not hold ``value``. Ties take the largest value.
    """
    bucket = F.floor(F.unix_timestamp(ts) / bucket_seconds)
    left = left.withColumn("bucket", bucket)
    right = right.select(*keys, ts, value).withColumn("bucket", bucket)
    best = right.groupBy(*keys, "bucket").agg(F.max(F.struct(ts, value))[value].alias("best"))
    wanted = left.select(*keys, "bucket").distinct()
    over_buckets = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.join(best, [*keys, "bucket"], "full").withColumn(
        "carried", F.last("best", ignorenulls=True).over(over_buckets)
    ).select(*keys, "bucket", "carried")
    rows = left.withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("side", F.lit(1))
    marks = right.withColumn("side", F.lit(0))
    inside = Window.partitionBy(*keys, "bucket").orderBy(ts, "side", value).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks, allowMissingColumns=True).withColumn("inside", F.last(value, ignorenulls=True).over(inside))
    return found.where("side = 1").join(carried, [*keys, "bucket"], "left").withColumn(
        value, F.coalesce("inside", "carried")
    ).drop("side", "inside", "carried", "bucket")
