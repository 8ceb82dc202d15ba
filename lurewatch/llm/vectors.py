"""Near-duplicate embeddings: int8 tile products with error bounds, exact cosines for what they leave open.

A unit vector x is kept as scale * q, q in -127..127, with the exact length e of what rounding lost. Then
x.y <= scale_x * scale_y * q_x.q_y + e_x + (1 + e_x) * e_y, whatever the vectors. The integer products of a pair of
tiles are one matrix product; only pairs whose bound reaches the threshold are computed again in double precision.

Equal vectors are one class from the start. Classes lie in the cell of their nearest pivot (``PIVOTS`` of them, a hash
sample), cells are split into tiles of at most about ``TILE_ROWS`` rows, so a cell may hold any part of the rows. Angles to
the pivots rule tile pairs out by the triangle inequality; all others are multiplied. A tile pair gives back one row per
linked vector: how many it is linked with there, and the smallest vector of its component there. So a group of n near
copies costs rows in proportion to n for each tile pair, never its pairs.

Defined results: a vector that is null, zero, or holds null or non-finite components, and any vector against one of
another length, is linked with nothing. Repeated rows are copies of one another. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import stored
from lurewatch.operators.components import connected_components

SIMILARITY = 0.9
PIVOTS, TILE_ROWS, TILE_BYTES = 64, 2048, 8 << 20
#: Products of int8 are exact in float32 up to this many dimensions at a time: 127 * 127 * 1024 < 2 ** 24.
EXACT_DIMENSIONS = 1024
SLACK = 1e-9
_FRAMES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows."""
    wide = raw.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of the rounding errors."""
    scale = np.abs(unit).max(axis=1) / 127
    steps = np.rint(unit / scale[:, None])
    lost = unit - steps * scale[:, None]
    return steps.astype(np.int8), scale, np.sqrt((lost * lost).sum(axis=1)) + 1e-12


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose cosine may reach the threshold."""
    (steps_a, scale_a, lost_a), (steps_b, scale_b, lost_b) = a, b
    product = np.zeros((len(steps_a), len(steps_b)))
    for at in range(0, steps_a.shape[1], EXACT_DIMENSIONS):
        part = slice(at, at + EXACT_DIMENSIONS)
        product += steps_a[:, part].astype(np.float32) @ steps_b[:, part].astype(np.float32).T
    product *= scale_a[:, None]
    product *= scale_b[None, :]
    product += lost_a[:, None]
    product += (1 + lost_a[:, None]) * lost_b[None, :]
    return np.nonzero(product >= threshold - 1e-12)


def cosines(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.einsum("ij,ij->i", a[rows[part]], b[columns[part]])
    return out


def roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n items' component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, check, dims, raw = [], [], [], []
        for vector in batch.column(1).to_pylist():
            own = None
            if vector and None not in vector:
                own = np.array(vector, np.float64) + 0.0  # no negative zeros
                if not np.isfinite(own).all() or not own.any():
                    own = None
            if own is None:
                for column in (node, check, dims, raw):
                    column.append(None)
                continue
            both = xxhash.xxh3_128_digest(own.tobytes())
            node.append(int.from_bytes(both[:8], "little", signed=True))
            check.append(int.from_bytes(both[8:], "little", signed=True))
            dims.append(len(own))
            raw.append(own.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
            names=names)


def _rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _placed(batches: Iterator[pd.DataFrame], pivots: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dims, own in batch.groupby("dims"):
            cosine = units(_rows(own["raw"])) @ pivots[dims].T
            yield own.assign(cell=cosine.argmax(axis=1).astype("int32"))


def _packed(group: pd.DataFrame, pivots: dict[int, np.ndarray]) -> pd.DataFrame:
    dims = int(group["dims"].iloc[0])
    angles = np.arccos(np.clip(units(_rows(group["raw"])) @ pivots[dims].T, -1, 1))
    return pd.DataFrame({
        "dims": [dims], "cell": [int(group["cell"].iloc[0])], "tile": [int(group["tile"].iloc[0])],
        "nodes": [group["node"].to_numpy(np.int64).tobytes()], "copies": [group["copies"].to_numpy(np.int64).tobytes()],
        "raw": [b"".join(group["raw"])], "near": [angles.min(axis=0)], "far": [angles.max(axis=0)]})


def _multiplied(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            same = row.name_a == row.name_b
            one, nodes_a, copies_a = units(np.frombuffer(row.raw_a).reshape(-1, row.dims)), *(np.frombuffer(x, np.int64) for x in (row.nodes_a, row.copies_a))
            other, nodes_b, copies_b = units(np.frombuffer(row.raw_b).reshape(-1, row.dims)), *(np.frombuffer(x, np.int64) for x in (row.nodes_b, row.copies_b))
            i, j = possible(quantised(one), quantised(other), threshold)
            if same:
                i, j = i[i < j], j[i < j]
            linked = cosines(one, other, i, j) >= threshold
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            shift = 0 if same else len(one)
            nodes, copies = (nodes_a, copies_a) if same else (np.concatenate([nodes_a, nodes_b]), np.concatenate([copies_a, copies_b]))
            j = j + shift
            links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
            used = np.flatnonzero(links)
            yield pd.DataFrame({"node": nodes[used], "links": links[used].astype(np.int64), "root": nodes[roots(i, j, len(nodes))[used]]})


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles that the pivots' angles don't rule out, each once, itself included. A tile meets the cells whose
    members' angles to their own pivot are close enough to its own angles to that pivot: a join on the cell."""
    reach = math.acos(threshold) + SLACK
    about = tiles.select("name", "dims", "cell", "near", "far")
    cells = about.groupBy("dims", "cell").agg(
        F.min(F.get("near", F.col("cell"))).alias("low"), F.max(F.get("far", F.col("cell"))).alias("high"))
    visits = about.join(F.broadcast(cells.withColumnRenamed("cell", "to")), "dims").where(  # PIVOTS rows for each length
        (F.get("near", F.col("to")) - reach <= F.col("high")) & (F.get("far", F.col("to")) + reach >= F.col("low")))
    there = about.select(F.col("name").alias("name_b"), "dims", F.col("cell").alias("to"), F.col("near").alias("near_b"), F.col("far").alias("far_b"))
    apart = F.exists(F.arrays_zip("near", "far", "near_b", "far_b"), lambda x: (x["near"] - reach > x["far_b"]) | (x["near_b"] - reach > x["far"]))
    return visits.join(there, ["dims", "to"]).where((F.col("name") <= F.col("name_b")) & ~apart).select(
        F.col("name").alias("name_a"), "name_b", "dims")


def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = SIMILARITY) -> DataFrame:
    """Key, n_links, component_id (smallest key that links reach) and kept (whether that is the key itself)."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    names = ["id", "node", "check", "dims", "raw"]
    rows = stored(vectors.select(key, vector).mapInArrow(
        lambda batches: _read(batches, names), f"id {kind}, node long, check long, dims int, raw binary"), "vectors")
    classes = rows.where("node IS NOT NULL").groupBy("node", "check").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("raw").alias("raw")).drop("check")
    classes = stored(classes, "classes")
    lengths = [r["dims"] for r in classes.select("dims").distinct().collect()]  # the few lengths that embeddings have
    pivots = {d: units(_rows([r["raw"] for r in classes.where(F.col("dims") == d).orderBy("node").limit(PIVOTS).collect()])) for d in lengths}
    held = spark.sparkContext.broadcast(pivots)
    placed = stored(classes.select("node", "copies", "dims", "raw").mapInPandas(
        lambda batches: _placed(batches, held.value), "node long, copies long, dims int, raw binary, cell int"), "cells")
    room = F.least(F.lit(TILE_ROWS), F.greatest(F.lit(64), F.lit(TILE_BYTES) / (8 * F.col("dims")))).cast("long")
    sizes = placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / F.first(room)).alias("tiles"))
    tiled = placed.join(F.broadcast(sizes), ["dims", "cell"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packed = tiled.drop("tiles").groupBy("dims", "cell", "tile").applyInPandas(
        lambda group: _packed(group, held.value),
        "dims int, cell int, tile int, nodes binary, copies binary, raw binary, near array<double>, far array<double>")
    before = spark.conf.get(_FRAMES)
    spark.conf.set(_FRAMES, "2")  # a row holds two tiles
    try:
        tiles = stored(packed.withColumn("name", F.format_string("%d/%d/%d", "dims", "cell", "tile")), "tiles")
        pairs = stored(_tile_pairs(tiles, threshold), "tile-pairs")
        side = lambda s: tiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("name", "nodes", "copies", "raw")])
        found = stored(
            pairs.join(side("a"), "name_a").join(side("b"), "name_b").mapInPandas(
                lambda batches: _multiplied(batches, threshold), "node long, links long, root long"), "linked")
    finally:
        spark.conf.set(_FRAMES, before)
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = stored(classes.select("node", "id", "copies").join(components, "node", "left").join(counts, "node", "left").select(
        "node", "id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = named.join(smallest, "component").select("node", "n_links", "component_id")
    own = F.coalesce("component_id", "id")
    return rows.select("id", "node").join(of_class, "node", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.col("id").eqNullSafe(own).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    return linked(vectors)
