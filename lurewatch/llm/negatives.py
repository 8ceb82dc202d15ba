"""Hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Vectors become whole numbers, floor(256 * x) for each component. Rows lie in the order of label, length, Hilbert curve (over the
``CURVE_DIMENSIONS`` components of largest variance) and key, cut into Parquet rows of ``BLOCK_ROWS`` vectors; a block's zone map
holds the least and greatest value of each component. Interval arithmetic on a zone map bounds the inner products of an anchor with
all rows of the block, so an anchor reads only the blocks that may hold a row of one of its windows of scores.

1. Positives: an anchor's own block gives a first floor, the score of its last positive there. All blocks of its label whose upper
   bound reaches the floor are read.
2. Negatives: each positive's score gives a window. In each group of blocks the one with the greatest upper bound is read first and
   gives each window a floor; then all blocks are read whose bounds meet a window above its floor.

Anchors and blocks meet in cells of about ``CELL_ANCHORS`` x ``CELL_BLOCKS``, a cell is a task's work of bounded size and gives back
the best of each window, so neither a label nor a vector that most rows have gathers in one task.

Defined results: rows with a null label or vector, with null or non-finite components (also 256 times itself) take no part; vectors of
another length are no candidates of an anchor, empty ones have the inner product 0. Keys are whole numbers; rows of one key are rows of
their own, and each anchor row gives its results; a row without a key is no anchor and comes last among equal scores. Scores beyond a
long are cut to its range. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import stored

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
BLOCK_ROWS, CELL_ANCHORS, CELL_BLOCKS = 256, 64, 64
CURVE_DIMENSIONS, CURVE_BITS = 8, 6
LONGEST = 2**63 - 1
SLACK = 1e-9
ROW = "id long, label int, dims int, anchor boolean, curve long, row binary"
BLOCK = "block long, label int, dims int, ids array<long>, anchors array<boolean>, rows binary, low binary, high binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position along the Hilbert curve of rows of whole coordinates below 2 ** bits (Skilling's transform)."""
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    top = bits - 1
    for bit in range(top, 0, -1):
        below = np.uint64((1 << bit) - 1)
        for i in range(len(axes)):
            on = (axes[i] >> np.uint64(bit)) & np.uint64(1) == 1
            swap = np.where(on, np.uint64(0), (axes[0] ^ axes[i]) & below)
            axes[0] = axes[0] ^ np.where(on, below, swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for bit in range(top, 0, -1):
        on = (axes[-1] >> np.uint64(bit)) & np.uint64(1) == 1
        turn ^= np.where(on, np.uint64((1 << bit) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for bit in range(top, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ turn) >> np.uint64(bit)) & np.uint64(1))
    return key


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, cut to the range of a long."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -LONGEST, LONGEST).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of a with anything between low and high, by interval arithmetic."""
    over, under = np.maximum(a, 0), np.minimum(a, 0)
    slack = SLACK * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
    return over @ low.T + under @ high.T - slack, over @ high.T + under @ low.T + slack


def _wide(rows: list[bytes], dims: int) -> np.ndarray:
    kind = lambda x: np.int16 if len(x) == 2 * dims else np.float64
    return np.array([np.frombuffer(x, kind(x)) for x in rows], np.float64).reshape(len(rows), dims)


def _narrow(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.int16) if not rows.size or np.abs(rows).max() < 2**15 else rows


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """n, sum and sum of squares of each component, by length of the vector."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for vector in batch.column(0).to_pylist():
            own = np.floor(256 * np.array(vector, np.float64))
            own = own if np.abs(own).max(initial=0) < 2**31 else np.clip(own, -(2**31), 2**31)
            sums[len(own)] = sums.get(len(own), 0) + np.stack([np.ones(len(own)), own, own * own])
    for dims, (n, total, squares) in sums.items():
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"dims": np.int32(dims), "i": np.arange(dims, dtype=np.int32), "n": n, "total": total, "squares": squares}),
                                         preserve_index=False)


def _curves(moments: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the components that the curve runs through, with the start and width of their cells."""
    table = moments.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).withColumn(
        "mean", F.expr("total / n")).withColumn("spread", F.expr("sqrt(greatest(squares / n - mean * mean, 0))"))
    place = F.row_number().over(Window.partitionBy("dims").orderBy(F.desc("spread"), "i"))  # a row for each component
    out: dict[int, list] = {}
    for row in table.withColumn("place", place).where(F.col("place") <= CURVE_DIMENSIONS).orderBy("dims", "place").collect():
        width = max(5 * row["spread"] / (1 << CURVE_BITS), 1e-9)
        out.setdefault(row["dims"], []).append((row["i"], row["mean"] - 2.5 * row["spread"], width))
    return {d: tuple(np.array(x) for x in zip(*rows)) for d, rows in out.items()}


def _keyed(batches: Iterator[pa.RecordBatch], curves: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, dims, curve = [], [], []
        for vector in batch.column(3).to_pylist():
            own = np.floor(256 * np.array(vector, np.float64))
            at = 0
            if len(own):
                index, start, width = curves[len(own)]
                cells = np.clip((own[index.astype(int)] - start) / width, 0, (1 << CURVE_BITS) - 1)
                at = int(hilbert(cells[None, :].astype(np.int64), CURVE_BITS)[0])
            rows.append(_narrow(own).tobytes())
            dims.append(len(own))
            curve.append(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), batch.column(2), pa.array(curve, pa.int64()), pa.array(rows, pa.binary())],
            names=["id", "label", "dims", "anchor", "curve", "row"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one label and length, up to BLOCK_ROWS, with their zone map."""
    part, number, held = TaskContext.get().partitionId(), 0, []

    def block() -> pa.RecordBatch:
        nonlocal number
        label, dims = held[0]["label"], held[0]["dims"]
        rows = _wide([x["row"] for x in held], dims)
        number += 1
        return pa.RecordBatch.from_pylist([{
            "block": (part << 32) + number, "label": label, "dims": dims, "ids": [x["id"] for x in held], "anchors": [x["anchor"] for x in held],
            "rows": _narrow(rows).tobytes(), "low": rows.min(axis=0).tobytes(), "high": rows.max(axis=0).tobytes()}],
            schema=pa.schema([("block", pa.int64()), ("label", pa.int32()), ("dims", pa.int32()), ("ids", pa.list_(pa.int64())),
                              ("anchors", pa.list_(pa.bool_())), ("rows", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]))

    for batch in batches:
        for row in batch.to_pylist():
            if held and (len(held) == BLOCK_ROWS or (held[0]["label"], held[0]["dims"]) != (row["label"], row["dims"])):
                yield block()
                held = []
            held.append(row)
    if held:
        yield block()


def _block_rows(rows: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(rows, np.int16 if len(rows) == 2 * n * dims else np.float64).reshape(n, dims).astype(np.float64)


def _anchors(batches: Iterator[pa.RecordBatch], positives: int) -> Iterator[pa.RecordBatch]:
    """Each anchor row with the score of its last positive in its own block (null if that has too few)."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            rows = _block_rows(x["rows"], len(x["ids"]), x["dims"])
            for i in np.flatnonzero(x["anchors"]):
                others = np.sort(np.delete(products(rows[i : i + 1], rows)[0], i))
                out.append({"uid": (x["block"] << 8) + int(i), "id": x["ids"][i], "label": x["label"], "dims": x["dims"], "row": _narrow(rows[i]).tobytes(),
                            "scores": [], "floors": [int(others[-positives]) if len(others) >= positives else None]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("uid", pa.int64()), ("id", pa.int64()), ("label", pa.int32()), ("dims", pa.int32()), ("row", pa.binary()), ("scores", pa.list_(pa.int64())),
            ("floors", pa.list_(pa.int64()))]))


def _windows(scores, floors, low: int, high: int) -> list[tuple[int, int]]:
    """An anchor's windows of scores, from their floor: of positives everything, of negatives the range of each positive's score."""
    floors = [-LONGEST if f is None or f != f else int(f) for f in floors]
    if not len(scores):
        return [(f, LONGEST) for f in floors]
    return [(max(-(-low * int(s) // 100), f), high * int(s) // 100) for s, f in zip(scores, floors)]


class _Search:
    """What the functions inside tasks need: whether the label has to be the same, how many rows a window takes, its range."""

    def __init__(self, same: bool, best: int, low: int, high: int):
        self.same, self.best, self.low, self.high = same, best, low, high

    def choose(self, key: tuple, anchors: pd.DataFrame, zones: pd.DataFrame, first: bool) -> pd.DataFrame:
        """The blocks of a cell that have to be read, each with the anchors that it is read for."""
        wanted: dict[int, list[int]] = {}
        for dims, own in anchors.groupby("dims"):
            there = zones[zones["dims"] == dims]
            if not len(there):
                continue
            a = _wide(own["row"].tolist(), dims)
            stack = lambda c: np.array([np.frombuffer(x) for x in there[c]]).reshape(len(there), dims)
            least, most = bounds(a, stack("low"), stack("high"))
            right = (own["label"].to_numpy()[:, None] == there["label"].to_numpy()[None, :]) == self.same
            blocks, uids = there["block"].tolist(), own["uid"].tolist()
            for i, (scores, floors) in enumerate(zip(own["scores"], own["floors"])):
                meets = np.zeros(len(there), bool)
                for low, high in _windows(scores, floors, self.low, self.high):
                    meets |= (low <= high) & (most[i] >= low) & (least[i] <= high)
                meets &= right[i]
                if first and meets.any():
                    meets = np.arange(len(there)) == np.where(meets, most[i], -np.inf).argmax()
                for j in np.flatnonzero(meets):
                    wanted.setdefault(blocks[j], []).append(uids[i])
        return pd.DataFrame({"across": np.int32(key[0]), "down": np.int32(key[1]), "block": np.array(list(wanted), np.int64),
                             "uids": pd.Series(list(wanted.values()), dtype=object)})

    def read(self, anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """The best rows of each window of a cell's anchors in the blocks that were chosen for them."""
        about = {x.uid: (x, _windows(x.scores, x.floors, self.low, self.high)) for x in anchors.itertuples(index=False)}
        found: list[tuple] = []
        for x in blocks.itertuples(index=False):
            ids = np.array([LONGEST if v is None or v != v else int(v) for v in x.ids], np.int64)
            own = [about[u] for u in x.uids]
            scores = products(_wide([a.row for a, _ in own], x.dims), _block_rows(x.rows, len(ids), x.dims))
            for (a, windows), line in zip(own, scores):
                if a.uid >> 8 == x.block:
                    line = line.copy()
                    line[a.uid & 255] = -LONGEST - 1  # itself
                for w, (low, high) in enumerate(windows):
                    at = np.flatnonzero((line >= low) & (line <= high))
                    if len(at) > self.best:
                        at = at[line[at] >= np.partition(line[at], len(at) - self.best)[len(at) - self.best]]
                    at = at[np.lexsort((ids[at], -line[at]))][: self.best]
                    found += [(a.uid, w, int(line[k]), int(ids[k]), (int(x.block) << 8) + int(k)) for k in at]
        best = pd.DataFrame(found, columns=["uid", "window", "score", "id", "row"]).sort_values(["uid", "window", "score", "id", "row"], ascending=[True, True, False, True, True])
        return best.groupby(["uid", "window"]).head(self.best).astype({"window": "int32"})


def _searched(anchors: DataFrame, blocks: DataFrame, search: _Search, first: bool = False) -> DataFrame:
    """(uid, window, rank, score, id): the first rows of each anchor's windows. ``first`` reads one block of each cell alone."""
    across = max(1, math.ceil(anchors.count() / CELL_ANCHORS))
    down = max(1, math.ceil(blocks.count() / CELL_BLOCKS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = anchors.withColumn("across", dealt("uid", across)).select("*", every(down).alias("down"))
    zones = blocks.select("block", "label", "dims", "low", "high").withColumn("down", dealt("block", down)).select("*", every(across).alias("across"))
    chosen = stored(asked.groupBy("across", "down").cogroup(zones.groupBy("across", "down")).applyInPandas(
        lambda key, a, z: search.choose(key, a, z, first), "across int, down int, block long, uids array<long>"), "chosen")
    there = chosen.join(blocks.select("block", "dims", "ids", "rows"), "block")
    found = asked.groupBy("across", "down").cogroup(there.groupBy("across", "down")).applyInPandas(
        lambda a, b: search.read(a, b), "uid long, window int, score long, id long, row long")
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id", "row")  # search.best rows of each cell
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.best)
    return stored(ranked.select("uid", "window", "rank", "score", F.when(F.col("id") < LONGEST, F.col("id")).alias("id")), "found")


def blocks_of(vectors: DataFrame, key: str, vector: str, label: str, anchors: Column) -> DataFrame:
    """The stored blocks with their zone maps."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
                          F.col(vector).alias("vector"), finite.alias("finite")).where("label IS NOT NULL AND finite").drop("finite")
    curves = _curves(rows.select("vector").mapInArrow(_moments, "dims int, i int, n double, total double, squares double"))
    keyed = stored(rows.mapInArrow(lambda batches: _keyed(batches, curves), ROW), "curve")
    order = ["label", "dims", "curve", "id"]
    return stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, BLOCK), "blocks")


def hard_negatives(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that ``anchors`` names and each of its
    first ``positives`` other rows of its label, the first ``negatives`` rows of other labels with ``low`` to ``high`` % of that score."""
    blocks = blocks_of(vectors, key, vector, label, anchors)
    asking = stored(blocks.mapInArrow(lambda batches: _anchors(batches, positives),
                                      "uid long, id long, label int, dims int, row binary, scores array<long>, floors array<long>"), "anchors")
    near = _searched(asking, blocks, _Search(True, positives, low, high))
    near = near.select("uid", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    scores = near.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    empty = F.expr("transform(scores, x -> cast(null as long))")
    windows = stored(asking.drop("scores", "floors").join(scores, "uid").withColumn("floors", empty), "windows")
    search = _Search(False, negatives, low, high)
    floors = _searched(windows, blocks, search, first=True).where(F.col("rank") == negatives).groupBy("uid").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("known"))
    raised = F.transform("scores", lambda _, i: F.element_at("known", i))
    found = _searched(stored(windows.drop("floors").join(floors, "uid", "left").withColumn("floors", raised).drop("known"), "windows"), blocks, search)
    return found.join(near, (found["uid"] == near["uid"]) & (found["window"] + 1 == near["place"])).drop(near["uid"]).join(
        asking.select("uid", F.col("id").alias("anchor_id")), "uid").select(
            "anchor_id", "positive_id", "rank", found["id"].alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def digest(vectors: DataFrame) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", changed.alias("label")), anchors=F.col("vec_id") % 100 == 0)
