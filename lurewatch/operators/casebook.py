"""Incidents with a status: evidence routed in order of time, containments in between.

Evidence joins the open incident of its campaign, else the newest open incident that holds evidence of its employee; where there is none
it opens one, and an incident without a campaign takes that of the first evidence that has one. A containment closes the open incidents of
its campaigns and those that hold evidence of its employee; later evidence opens new ones.

This is a fold over time. Where evidence with a campaign does not follow the employee (``follow`` off), campaigns do not bear on one another:
they are folded apart, then the employees' other evidence, each key's rows in order and no round twice. Where it does, campaigns and employees
hang together and there is one order for all: one task passes over all rows and holds the open incidents of each employee and campaign, no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.session import cut_lineage, partitions

ROUTED = "evidence_id long, ts timestamp, employee_id long, campaign_id string, root long"
#: What a fold reads: evidence (rank 1), what closes incidents (rank 0), and an employee's first evidence in an incident of another key.
_HAPPENINGS = ["evidence_id", "ts", "employee_id", "campaign_id", "rank", "root", "opened", "opener", "closed"]
#: Rows a batch of a fold; they are narrow.
BATCH = 10_000


def containments(steps: DataFrame, campaign_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved steps -> (campaign_id, at) and (employee_id, at) of what they close."""
    campaigns = steps.where("step = 'quarantine_messages'").join(campaign_of, "message_id").select("campaign_id", "at").distinct()
    people = steps.where("step in ('revoke_sessions', 'reset_credentials')").select("employee_id", "at").distinct()
    return campaigns, people


def incidents(routed: DataFrame, campaigns: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """routed(evidence_id, ts, employee_id, campaign_id, root) -> (root, opened, named, closed_at) and (employee_id, root, touched).

    ``named`` is the order and the campaign of the first evidence that had one."""
    order = F.struct("ts", "evidence_id")
    found = routed.groupBy("root").agg(
        F.min(order).alias("opened"), F.min(F.when(F.col("campaign_id").isNotNull(), F.struct(order.alias("at"), "campaign_id"))).alias("named"))
    touches = routed.groupBy("employee_id", "root").agg(F.min(order).alias("touched"))
    by_campaign = found.where("named is not null").select("root", F.col("named.campaign_id").alias("campaign_id"), F.col("named.at.ts").alias("since")).join(
        campaigns, "campaign_id").where("at > since").select("root", "at")
    by_person = touches.select("employee_id", "root", F.col("touched.ts").alias("since")).join(people, "employee_id").where("at > since").select("root", "at")
    closed = by_campaign.unionByName(by_person).groupBy("root").agg(F.min("at").alias("closed_at"))
    return found.join(closed, "root", "left"), touches


def _happenings(rows: DataFrame, rank: int = 1) -> DataFrame:
    """The rows with all columns that a fold reads; those that they do not have are null."""
    kinds = dict(zip(_HAPPENINGS, ("bigint", "timestamp", "bigint", "string", "int", "bigint", "bigint", "bigint", "bigint")))
    return rows.select(*[F.lit(rank).alias("rank") if c == "rank" else (F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _closings(rows: DataFrame) -> DataFrame:
    return _happenings(rows.withColumn("evidence_id", F.lit(-1)).withColumnRenamed("at", "ts"), rank=0)


def _folded(happenings: DataFrame, key: str | None, fold: Callable[[], Callable[..., int | None]]) -> DataFrame:
    """Each evidence with its root: the rows of a key, or all, go through one fold in order of time, closings before evidence.
    ``fold`` starts a fold, which is called with each row and gives the root or nothing; it is an inner function, so that workers need no module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step = None, fold()
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("evidence_id", "employee_id", "campaign_id", "rank", "root", "opened", "opener", "closed", "at")}
            keys = columns.get(key) or [None] * batch.num_rows
            roots = []
            for own, row in zip(keys, zip(*columns.values())):
                if own != group:
                    group, step = own, fold()
                roots.append(step(*row))
            out = pa.array(roots, pa.int64())
            told = batch.select(["evidence_id", "ts", "employee_id", "campaign_id"])
            yield pa.RecordBatch.from_arrays([*told.columns, out], names=[*told.schema.names, "root"]).filter(out.is_valid())

    spark = happenings.sparkSession
    dealt = happenings.repartition(partitions(spark), key) if key else happenings.repartition(1)
    order = [key] if key else []
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(BATCH))
    try:
        return cut_lineage(dealt.sortWithinPartitions(*order, "ts", "rank", "evidence_id").withColumn("at", F.unix_micros("ts")).mapInArrow(run, ROUTED))
    finally:
        spark.conf.set(conf, before)


def _of_campaign() -> Callable[[], Callable[..., int | None]]:
    """The fold of one campaign's evidence: one incident at a time, and who is in it."""

    def start() -> Callable[..., int | None]:
        root, people = None, set()

        def step(evidence, who, campaign, rank, *_):
            nonlocal root
            if rank == 0:
                if root is not None and (who is None or who in people):
                    root = None
                return None
            if root is None:
                root = evidence
                people.clear()
            people.add(who)
            return root

        return step

    return start


def _of_person() -> Callable[[], Callable[..., int | None]]:
    """The fold of one employee's evidence without a campaign, among the incidents that hold other evidence of the employee."""

    def start() -> Callable[..., int | None]:
        known: list[tuple] = []  # (when it opened, its opener, root, when it closes), of the employee's own ones unknown
        never, always = float("inf"), float("-inf")  # rows without a time come first

        def step(evidence, who, campaign, rank, root, opened, opener, closed, at):
            if rank == 0:
                known[:] = [k for k in known if k[3] is not None]
                return None
            if root is not None:
                known.append((always if opened is None else opened, opener, root, never if closed is None else closed))
                return None
            at = always if at is None else at
            known[:] = [k for k in known if k[3] is None or k[3] > at]
            if not known:
                known.append((at, evidence, evidence, None))
            return max(known, key=lambda k: k[:2])[2]

        return step

    return start


def _of_all() -> Callable[[], Callable[..., int | None]]:
    """The fold of all evidence. An incident is [root, whether it is open, its campaign, its place in the order of opening]."""

    def start() -> Callable[..., int | None]:
        by_campaign: dict[str, list] = {}
        by_person: dict[int, list[list]] = defaultdict(list)
        count = 0

        def shut(case: list) -> None:
            case[1] = False
            if by_campaign.get(case[2]) is case:
                del by_campaign[case[2]]

        def step(evidence, who, campaign, rank, *_):
            nonlocal count
            if rank == 0:
                for case in by_person.pop(who, ()) if campaign is None else [by_campaign[campaign]] if campaign in by_campaign else ():
                    if case[1]:
                        shut(case)
                return None
            mine = by_person.get(who, ())
            case = by_campaign.get(campaign) if campaign is not None else None
            if case is None and who is not None:
                mine = [c for c in mine if c[1]]
                case = max(mine, key=lambda c: c[3], default=None)
            if case is None:
                count += 1
                case = [evidence, True, None, count]
            if case[2] is None and campaign is not None:
                case[2] = campaign
                by_campaign[campaign] = case
            if who is not None:
                by_person[who] = mine if any(c is case for c in mine) else [*(c for c in mine if c[1]), case]
            return case[0]

        return step

    return start


def route(exposures: DataFrame, campaigns: DataFrame, people: DataFrame, follow: bool = False) -> DataFrame:
    """(evidence_id, ts, employee_id, campaign_id, root): ``root`` is the evidence that opened the incident. ``exposures`` has
    evidence_id, ts, employee_id and the campaign_id that the evidence points to, or null. With ``follow`` evidence whose campaign has
    no open incident follows its employee; without, only evidence without a campaign does."""
    rows = exposures.select("evidence_id", "ts", "employee_id", "campaign_id").where("employee_id is not null or campaign_id is not null")
    if follow:
        return _folded(_happenings(rows).union(_closings(campaigns)).union(_closings(people)), None, _of_all())
    named = rows.where("campaign_id is not null")
    involved = named.select("campaign_id", "employee_id").distinct().join(people, "employee_id")
    first = _folded(_happenings(named).union(_closings(campaigns)).union(_closings(involved)), "campaign_id", _of_campaign())
    known, touches = incidents(first, campaigns, people)
    held = touches.join(known.select("root", "opened", "closed_at"), "root").where("employee_id is not null").select(
        "employee_id", "root", F.col("touched.ts").alias("ts"), F.col("touched.evidence_id").alias("evidence_id"),
        F.unix_micros("opened.ts").alias("opened"), F.col("opened.evidence_id").alias("opener"), F.unix_micros("closed_at").alias("closed"))
    other = _happenings(rows.where("campaign_id is null")).union(_happenings(held)).union(_closings(people))
    return first.union(_folded(other, "employee_id", _of_person()))


def book(exposures: DataFrame, routed: DataFrame, campaigns: DataFrame, people: DataFrame) -> DataFrame:
    """A row for each incident: root, campaign_id, severity, status, opened_at, closed_at, affected, evidence."""
    known, _ = incidents(routed, campaigns, people)
    sums = exposures.select("evidence_id", "severity").join(routed.select("evidence_id", "root", "employee_id"), "evidence_id").groupBy("root").agg(
        F.max("severity").alias("severity"), F.countDistinct("employee_id").alias("affected"), F.count("*").alias("evidence"))
    return known.join(sums, "root").select(
        "root", F.col("named.campaign_id").alias("campaign_id"), "severity", F.when(F.col("closed_at").isNull(), "open").otherwise("contained").alias("status"),
        F.col("opened.ts").alias("opened_at"), "closed_at", "affected", "evidence")
