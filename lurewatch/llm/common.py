"""Reading the tables and keeping intermediate tables, shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.session import prepare, shared_folder

#: Rows and bytes per Arrow batch handed to Python: bounds a worker's memory when texts are many or long.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
SPACE = r"[\x20\x09-\x0D]+"


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of what the session runs from now on."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; also bounds the Arrow batches of what is computed from it."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends there, and readers prune its columns."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, when nothing that is still to run reads them."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def learned_from(key: Column, modulus: int) -> Column:
    """Whether a row may be learned from: crc32 of its id as text leaves another remainder than 2."""
    return F.crc32(key.cast("string").cast("binary")) % modulus != 2


def most_frequent(counted: DataFrame, by: list[str], item: str, keep: int) -> DataFrame:
    """About the ``keep`` most frequent items (column n) of each group. A histogram of log counts, some hundred rows a
    group, gives the lowest level that is kept; of that level as large a hash share as there is room for."""
    level = F.floor(F.log2(F.col("n")) * 8)
    levels: dict[tuple, list[tuple[int, int]]] = {}
    for row in counted.groupBy(*by, level.alias("level")).agg(F.count("*").alias("k")).collect():
        levels.setdefault(tuple(row[b] for b in by), []).append((row["level"], row["k"]))
    cuts = [] if levels or by else [(0, 1.0)]
    for group, own in levels.items():
        room = keep
        for low, k in sorted(own, reverse=True):
            cut = (*group, low, min(1.0, room / k))
            room -= k
            if room <= 0:
                break
        cuts.append(cut)
    if by:
        kinds = "".join(f"{b} {dict(counted.dtypes)[b]}, " for b in by)
        table = counted.sparkSession.createDataFrame(cuts, f"{kinds}__low long, __share double")
        joined = counted.join(F.broadcast(table), by)  # a row for each group
    else:
        joined = counted.select("*", F.lit(cuts[0][-2]).alias("__low"), F.lit(cuts[0][-1]).alias("__share"))
    share = F.pmod(F.xxhash64(item), F.lit(1_000_003)) / 1_000_003.0
    return joined.where((level > F.col("__low")) | (level == F.col("__low")) & (share < F.col("__share"))).drop("__low", "__share")


def give_back() -> None:
    """Hands freed memory back to the system at the end of a task, as Python workers are used again by other stages."""
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries know how
        ctypes.CDLL(None).malloc_trim(0)
