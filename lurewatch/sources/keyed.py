"""Tables in files with insert-or-update by key.

Rows lie in folders by a hash of their key. A batch rewrites the folders that its keys fall into, beside the old ones, and then writes
a pointer that names the batch that last wrote each folder. Readers follow the newest pointer, so they see a batch whole or not at all;
a batch that already has a pointer is not applied again, so a batch that a restarted stream repeats changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def newest(key: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the last row of each key in that order; the maximum combines before the shuffle."""

    def merge(rows: DataFrame) -> DataFrame:
        whole = F.struct(*rows.columns)
        return rows.groupBy(*key).agg(F.max_by(whole, F.struct(*order)).alias("__row")).select("__row.*")

    return merge


class KeyedTable:
    """``merge`` makes of old and new rows together one row a key; it must not matter in which order batches come in."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.merge, self.buckets = spark, path, schema, key, merge, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _versions(self) -> list[int]:
        """Numbers of the batches that have a whole pointer."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = [x.getPath() for x in files.listStatus(at)]
        return sorted(int(p.getName()) for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _pointer(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/pointers/{version}")
        return {r["bucket"]: r["batch"] for r in rows.collect()}  # a row for each bucket

    def _of(self, pointer: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/batch={batch}/bucket={b}" for b, batch in sorted(pointer.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        versions = self._versions()
        return self._of(self._pointer(versions[-1]) if versions else {})

    def before(self, batch: int) -> DataFrame:
        """The table as the batches before this one left it."""
        versions = [v for v in self._versions() if v < batch]
        return self._of(self._pointer(versions[-1]) if versions else {})

    def apply(self, rows: DataFrame, batch: int) -> bool:
        """Inserts or updates the rows as batch number ``batch``; False if that has been applied before."""
        versions = self._versions()
        if batch in versions:
            return False
        pointer = self._pointer(versions[-1]) if versions else {}
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        fresh = self.merge(rows.select(*self.columns))
        touched = [r[0] for r in fresh.select(bucket).distinct().collect()]  # buckets, a fixed number at most
        if touched:
            merged = self.merge(self._of(pointer, touched).unionByName(fresh))
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        pointer |= dict.fromkeys(touched, batch)
        self.spark.createDataFrame(sorted(pointer.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointers/{batch}")
        return True
