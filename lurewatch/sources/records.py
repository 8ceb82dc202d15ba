"""Lenient text sources: JSON lines and CSV, with the place of every row and the rejects.

A row's place is its file, the block of the file and its number there, which grows along a file; so "the last one" is a maximum per key,
whatever tasks read the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "corrupt"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema``, ``corrupt`` (the line, where it is no such record) and ``at`` (file, start, row)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    parsed = lines.select("value", place.alias("at")).withColumn(
        "record", F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    return parsed.where(F.trim("value") != "").select("record.*", "at")


def last_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key's last row in the files; corrupt rows and those without a key count for nothing."""
    return rows.where(F.col(CORRUPT).isNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct("at.file", "at.start", "at.row")).alias(value))


def read_corpora(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files below a folder, a corpus each: the columns, ``corrupt``, and ``source`` from the name of the corpus' folder."""
    read = spark.read.option("recursiveFileLookup", "true").option("header", "true").option("multiLine", "true").option("escape", '"').option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(f"{schema}, {CORRUPT} string").csv(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"corpus=([^/]+)/", 1)
    return read.withColumn("source", F.url_decode(folder))
