"""Streaming twins of the batch views. Every stream reads files, runs until its input is used up and leaves
a table in the shared folder; the table must equal the batch result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.operators import campaigns
from lurewatch.operators.components import connected_components
from lurewatch.session import cut_lineage, shared_folder
from lurewatch.sources.keyed import KeyedTable

WATERMARK = "24 hours"  # the campaign window; later events are not matched


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Appends the stream's rows to a parquet table and returns the table."""
    spark, table = stream.sparkSession, new_folder(stream.sparkSession, name)
    job = stream.writeStream.format("parquet").option("checkpointLocation", f"{table}-progress").outputMode("append").trigger(
        availableNow=True).start(table)
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def per_batch(stream: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Writes ``step(batch)`` of each micro-batch under its batch number, so a repeated batch replaces itself.

    In complete mode only the last batch holds the result.
    """
    spark, table = stream.sparkSession, new_folder(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        where = f"{table}/state=0" if mode == "complete" else f"{table}/batch={number}"
        step(batch).write.mode("overwrite").parquet(where)

    job = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{table}-progress").outputMode(mode).trigger(
        availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(table)


def arrivals(table: DataFrame, part: Column, order: list[int], name: str, step: Callable[[DataFrame, int], None]) -> None:
    """The rows arrive as files, a part at a time in that order; after each arrival the stream is started again where it ended and
    hands what is new to ``step`` with the number of the batch. A step that is repeated must change nothing."""
    spark = table.sparkSession
    folder = new_folder(spark, name)
    table.where(F.lit(False)).write.parquet(folder)  # a stream starts on a folder that is there
    stream = spark.readStream.schema(table.schema).parquet(folder)
    for value in order:
        table.where(part == value).write.mode("append").parquet(folder)
        job = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start()
        job.awaitTermination()


def incident_parts(exposures: DataFrame) -> DataFrame:
    """Per incident and employee what adds up over batches."""
    return merged_parts(exposures.select(
        "incident_id", "employee_id", "severity", F.lit(1).cast("long").alias("evidence"), F.col("ts").alias("created_at"), F.col("ts").alias("last_at")))


def merged_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("incident_id", "employee_id").agg(
        F.max("severity").alias("severity"), F.sum("evidence").alias("evidence"), F.min("created_at").alias("created_at"), F.max("last_at").alias("last_at"))


PARTS = "incident_id string, employee_id long, severity int, evidence long, created_at timestamp, last_at timestamp"


def incident_state(spark: SparkSession, name: str) -> KeyedTable:
    """State of incidents, a row for each employee in one, so that no incident is a hot key."""
    return KeyedTable(spark, new_folder(spark, name), PARTS, ["incident_id", "employee_id"], merged_parts)


def incident_view(state: KeyedTable) -> DataFrame:
    return state.read().groupBy("incident_id").agg(
        F.max("severity").alias("severity"), F.count("*").alias("affected"), F.sum("evidence").alias("evidence"),
        F.min("created_at").alias("created_at"), F.max("last_at").alias("last_at"))


def changed_incidents(batch: DataFrame, before: DataFrame) -> DataFrame:
    """(event, incident_id) of the incidents that a batch touches, against their state before it."""
    now = batch.groupBy("incident_id").agg(F.max("severity").alias("severity"))
    old = before.groupBy("incident_id").agg(F.max("severity").alias("was"))
    event = F.when(F.col("was").isNull(), "incident.created").when(F.col("severity") > F.col("was"), "incident.escalated").otherwise("incident.updated")
    return now.join(old, "incident_id", "left").select(event.alias("event"), "incident_id")


def grow_campaigns(labels: DataFrame | None, known: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """(message_id, campaign) after new mail arrived.

    The new mails are clustered with the known ones of the last 24 hours only. A cluster that touches
    several earlier campaigns joins them; the smallest campaign id survives.
    """
    if known is None or labels is None:
        return campaigns.clusters(arrived)
    span = arrived.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    window = campaigns.lists.WINDOW_SECONDS
    near = known.where(F.col("t").between(span["low"] - window, span["high"] + window))
    fresh = campaigns.clusters(near.unionByName(arrived))
    tagged = fresh.select("message_id", F.concat(F.lit("new|"), "campaign_id").alias("node"))
    before = labels.select("message_id", F.col("campaign_id").alias("old"))
    edges = tagged.join(before, "message_id").select(F.col("node").alias("a"), F.col("old").alias("b"))
    merged = connected_components(edges)
    every = tagged.unionByName(before.select("message_id", F.col("old").alias("node")))
    component = every.join(merged, "node", "left").select("message_id", F.coalesce("component", "node").alias("component")).distinct()
    oldest = component.groupBy("component").agg(F.min("message_id").alias("oldest"))
    return cut_lineage(component.join(oldest, "component").groupBy("message_id").agg(
        F.concat(F.lit("camp-"), F.min("oldest").cast("string")).alias("campaign_id")))
