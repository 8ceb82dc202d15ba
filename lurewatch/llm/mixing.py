"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``BLOCK`` documents in a hashed order. With weight w, block k (from 0) of a source is
released at slot floor(k / w) and due by slot ceil((k + 1) / w). Giving every slot to the released block with the earliest
deadline meets all deadlines, so after any number of slots each source is less than one block away from its share.

Weights are whole shares of a period of slots, so the schedule repeats: one period, whose length is a parameter, is
scheduled on the driver, and block k of a source with q slots in a period goes to period k div q, at the place of its
block k mod q. Everything that grows with the documents is joins and counts; ranks within a source come from counts of
hash ranges, so a source may hold any part of the rows.

When a source has run out its slots stay empty, the others keep their order: no row is dropped, repeated or sampled.
``in_mixture`` marks the slots before the first empty one, where the target weights hold.

Defined results: a null source is a source of its own; rows of equal keys are ordered at will; repeated rows take a
place each; a source without a weight gets the least one (one slot a period), weights of absent sources are ignored; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, PERIOD, TEMPER = 16, 4096, 0.5
#: Rows that are ranked together, about.
RANGE_ROWS = 4096
_FINE = 1 << 40


def shares(weights: dict, period: int) -> dict:
    """Whole slots of a period for each source, at least one, by largest remainder."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: (period - len(weights)) * Fraction(w) / total if total else Fraction(period - len(weights), len(weights)) for s, w in weights.items()}
    whole = {s: int(x) for s, x in exact.items()}
    rest = period - len(weights) - sum(whole.values())
    for s in sorted(exact, key=lambda s: (whole[s] - exact[s], str(s)))[:rest]:
        whole[s] += 1
    return {s: n + 1 for s, n in whole.items()}


def schedule(quota: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one period of sum(quota) slots: earliest deadline first among the blocks
    that are released."""
    period = sum(quota)
    release = lambda s, k: k * period // quota[s]
    due = lambda s, k: -(-(k + 1) * period // quota[s])
    waiting = [(0, due(s, 0), s, 0) for s in range(len(quota))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in quota]
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, by, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (by, s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < quota[s]:
            heapq.heappush(waiting, (release(s, k + 1), due(s, k + 1), s, k + 1))
    return slots


def scheduled(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict | None = None, block: int = BLOCK,
              period: int = PERIOD, temper: float = TEMPER, seed: int = 0) -> DataFrame:
    """docs with block, slot, place (in the block) and in_mixture. Without weights a source weighs its size to the power
    ``temper``."""
    spark = docs.sparkSession
    kind = docs.schema[source].dataType
    found = docs.groupBy(source).count().collect()  # a row for each source
    sizes = dict(sorted(map(tuple, found), key=lambda x: (x[0] is not None, str(x[0]))))  # whatever order they come in
    if weights is None:
        weights = {s: n**temper for s, n in sizes.items()}
    least = min([w for w in weights.values() if w > 0], default=1) * 1e-9
    quota = shares({s: weights.get(s, 0) or least for s in sizes}, max(period, 4 * len(sizes))) if sizes else {}
    names = list(quota)
    slots = dict(zip(names, schedule(list(quota.values()))))
    cycle = sum(quota.values())
    position = lambda s, k: k // quota[s] * cycle + slots[s][k % quota[s]]
    filled = min((position(s, n // block) for s, n in sizes.items()), default=0)

    ranges = spark.createDataFrame(
        [(s, i, quota[s], -(-sizes[s] // RANGE_ROWS)) for i, s in enumerate(names)],
        T.StructType([T.StructField("__source", kind), T.StructField("__s", T.LongType()), T.StructField("__quota", T.LongType()), T.StructField("__ranges", T.LongType())]))
    places = spark.createDataFrame([(i, k, at) for i, s in enumerate(names) for k, at in enumerate(slots[s])], "__s long, __turn long, __at long")

    own = docs.withColumn("__hash", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(_FINE)))
    own = own.join(F.broadcast(ranges), F.col(source).eqNullSafe(F.col("__source"))).withColumn(
        "__range", F.expr(f"__hash * __ranges div {_FINE}"))
    # Rows are dealt by source and range once: sources go by number, so that the ranges' starts meet them where they are.
    counts = own.groupBy("__s", "__range").agg(F.count("*").alias("__n"))
    before = counts.withColumn(
        "__before", F.sum("__n").over(Window.partitionBy("__s").orderBy("__range")) - F.col("__n")).select("__s", "__range", "__before").repartition("__s", "__range")
    ranked = own.withColumn("__rank", F.row_number().over(Window.partitionBy("__s", "__range").orderBy("__hash", key)))
    ranked = ranked.join(before, ["__s", "__range"]).withColumn("__place", F.col("__before") + F.col("__rank") - 1)
    ranked = ranked.withColumn("__block", F.expr(f"__place div {block}")).withColumn("__turn", F.expr("__block % __quota"))
    placed = ranked.join(F.broadcast(places), ["__s", "__turn"])
    slot = F.expr(f"__block div __quota * {cycle} + __at")
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("__block").alias("block"), slot.alias("slot"),
        (F.col("__place") % block).alias("place"), (slot < filled).alias("in_mixture"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The same rows and columns, written out in the order of the schedule; ``with_order`` reads it."""
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(how.get("key", "doc_id")).alias("__key"),
                      F.col(how.get("source", "source")).alias("__from"))
    found = scheduled(own, **(how | {"key": "__key", "source": "__from"}))
    return found.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("__row.*")


def with_order(docs: DataFrame, name: str = "mix_order") -> DataFrame:
    """What ``mixed`` wrote as Parquet and was read back in any order, with each row's place in the schedule: ascending, not
    without gaps. Files are numbered by slots, and rows within a file are in order. Null for rows that are in no file."""
    try:
        file = docs.metadataColumn("_metadata")  # a column of that name is another one
        part = F.regexp_extract(file["file_name"], r"^part-(\d+)-", 1).cast("long")
        cut = F.regexp_extract(file["file_name"], r"-c(\d+)[^-]*$", 1).cast("long")
        ordered = docs.withColumn(name, F.struct(part.alias("part"), cut.alias("cut"), file["row_index"].alias("row")))
        ordered.schema
        return ordered
    except AnalysisException:  # rows that come from no file
        return docs.withColumn(name, F.lit(None).cast("struct<part:long,cut:long,row:long>"))


def digest(docs: DataFrame) -> DataFrame:
    return scheduled(docs.select("doc_id", "source"))
