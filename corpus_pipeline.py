"""The corpus pipeline: language, near duplicates, secrets, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. A stage's
result is written as Parquet into the shared folder and read again, so that a lost executor costs no earlier stage.

Defined results: rows with a null or letterless text go in the first stage, so later stages meet none; an empty table
passes through all stages; columns besides doc_id, text, lang and source pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm import language, mixing, pieces, secrets, sketches
from lurewatch.llm.common import bounded, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without a letter are rejected. A short text between two languages stays."""
    names = docs.columns
    bounded(spark)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("text").alias("__text"))
    model = language.fit(docs.select("doc_id", "text", "lang"))
    found = language.predict(own, model, text="__text")
    return found.where(F.col("lang_pred") != language.UNKNOWN).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles at 0.8: the one with the smallest id. Equal rows are
    one document; rows of one id with different texts are not."""
    bounded(spark)
    own = docs.withColumn("__id", F.struct("doc_id", F.xxhash64("text").alias("text")))
    kept = sketches.near_duplicates(own, key="__id").where("kept").select("__id")
    return own.join(kept, "__id", "left_semi").dropDuplicates(["__id"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    bounded(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the files hold the slots of the schedule one after the other."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, and its place in the mixture: whoever reads the result by ``mix_order`` meets the sources
    by their weights, in whatever order files are read."""
    bounded(spark)
    return pieces.encode(mixing.with_order(docs.select("doc_id", "text")), carry=("mix_order",))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: The models, sketches and samples have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
