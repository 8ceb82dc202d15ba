"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles, as 64-bit hashes. Register i holds the smallest of exponential variates of
all shingles, rounded down on an exponential scale (base ``BASE``) and cut off at both ends; equal registers of two sets
become more likely with their Jaccard similarity, and the registers of a union are the larger ones of its parts.

1. Equal sets are one class from the start, so copies never meet one another.
2. ``BANDS`` bands of ``ROWS`` registers each put a class into buckets. A pair at similarity 0.8 shares a bucket with
   probability 1 - 8e-7. Classes that share two neighbouring bands are compared with a few leaders of their group first,
   so a large group of near copies costs a few comparisons each; then, ``ROUNDS`` times, with those of some members of
   other components in their buckets that their registers' last bits are closest to. Buckets that have come together in
   one component drop out. In what is left every pair of classes from different components is compared: large buckets
   chunk against chunk, with one link kept for each pair of components; small ones pair by pair.
3. Pairs of small buckets have to pass cheaper tests first: within the join by set sizes, by the shingles that no other class that is
   left has (exact bounds), and by the registers' last bits, then by a likelihood estimate from the registers and the
   known set sizes. The latter two leave out only what is more than ``SIGMAS`` standard errors below the threshold.
4. Every link is confirmed on the full sets.

Defined results: a text that is null or has no words is empty and linked with nothing (component_id = its own id); one
with fewer words than a shingle is one shingle of its whole sequence. Repeated rows get a result each. A null id is
allowed; components take the smallest id that is not null. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.llm.common import give_back, removed, stored
from lurewatch.operators.components import connected_components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, BASE, LEVELS = 60, 7, 1.001, 65_535
ESTIMATE_REGISTERS, SIGMAS = 128, 6.0
DRAWS, TRIES, ROUNDS = 3, 4, 1
#: Buckets of up to so many classes are compared pair by pair, larger ones in chunks of about so many classes.
PAIRED, CHUNK, COLUMNS = 32, 512, 8192
KNOWN_WORDS = 100_000
_MANY = BANDS * ROWS
BIT_WORDS = -(-_MANY // 64)

_draw = np.random.default_rng(20240607)
_FACTORS = _draw.integers(0, 1 << 31, _MANY, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, _MANY, dtype=np.uint32)
_BAND_FACTORS = _draw.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes. bytes.lower() and bytes.split() know just the letters A-Z and the
    six white space characters that are meant."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=len(own))], np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))
    out = hashes[: len(own) - words + 1]
    with np.errstate(over="ignore"):
        for k in range(1, words):
            out = _mixed(out) + hashes[k : len(own) - words + 1 + k]
    return np.unique(_mixed(out))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set that is not empty. The variates -log(1 - u) grow with u, so the smallest u of each
    register is found first and only that one is transformed."""
    short, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(_MANY, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        block = short[at : at + 512, None] * _FACTORS
        block += _SHIFTS
        np.minimum(least, block.min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(variate) / math.log(BASE)) + 30_000, 0, LEVELS).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_keys(own: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = (own.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
        return _mixed(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def last_bits(own: np.ndarray) -> np.ndarray:
    """The registers' last bits, in BIT_WORDS words."""
    bits = np.zeros(64 * BIT_WORDS, np.uint8)
    bits[:_MANY] = own & 1
    return np.packbits(bits).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], words: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, node, check, signs, bands, bits = [], [], [], [], [], []
        for text in batch.column(3).to_pylist():
            own = shingle_set(text, words)
            sizes.append(len(own))
            if not len(own):
                for column in (node, check, signs, bands, bits):
                    column.append(None)
                continue
            both = xxhash.xxh3_128_digest(own.tobytes())
            node.append(int.from_bytes(both[:8], "little", signed=True))
            check.append(int.from_bytes(both[8:], "little", signed=True))
            found = registers(own)
            signs.append(found[:ESTIMATE_REGISTERS].tobytes())
            bands.append(band_keys(found))
            bits.append(last_bits(found))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()),
             pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=names)
    _hashes.clear()
    give_back()


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id, high and low (128 bits that stand for the text), n, node and check (128 bits that stand for the set), registers and band keys;
    the latter null without words."""
    names = ["id", "high", "low", "n", "node", "check", "registers", "bands", "bits"]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, *_text_hashes(text), text).mapInArrow(
        lambda batches: _sketched(batches, words, names),
        f"id {kind}, high long, low long, n long, node long, check long, registers binary, bands array<long>, bits array<long>")


def _text_hashes(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), F.coalesce(F.col(text), F.lit(""))).alias(name) for k, name in enumerate(("high", "low"))]


def _chance(x: np.ndarray) -> np.ndarray:
    """That the first of two registers is larger, given the share x of what only the first set has."""
    return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the registers' order most likely, per row, given the set sizes."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - above - below
    u = (size_a / (size_a + size_b))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    tried = most * np.linspace(0, 1, 201)[None, :]
    first, second = _chance(u - (1 - u) * tried), _chance((1 - u) - u * tried)
    tiny = 1e-12
    score = above * np.log(first + tiny) + below * np.log(second + tiny) + same * np.log(np.maximum(1 - first - second, 0) + tiny)
    return tried[np.arange(len(tried)), score.argmax(axis=1)]


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    rows = lambda x: np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1)
    return pd.Series(likely_similarity(rows(a), rows(b), size_a.to_numpy(float), size_b.to_numpy(float)))


@F.pandas_udf(T.LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    sets = lambda x: np.frombuffer(x, np.uint64)
    return pd.Series([len(x) + len(y) - len(np.union1d(x, y)) for x, y in zip(map(sets, a), map(sets, b))], dtype="int64")


def _set_rows(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["members"] = [shingle_set(x, words).tobytes() for x in batch["text"]]
        yield batch[["node", "n", "members"]]


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingle) of sets(node, n, members), a set at a time."""
    for batch in batches:
        for node, members in zip(batch.column("node").to_pylist(), batch.column("members").to_pylist()):
            own = np.frombuffer(members, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own)], names=["node", "shingle"])


def _closer(similarity: float) -> str:
    return f"100 * shared >= {round(100 * similarity)} * (n_a + n_b - shared)"


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs(a, b) -> those whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("members_a"))
    other = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("members_b"))
    return pairs.join(one, "a").join(other, "b").withColumn("shared", _shared("members_a", "members_b")).where(_closer(similarity)).select("a", "b")


def _leaders(placed: DataFrame) -> DataFrame:
    """placed(bucket, node) -> pairs(node, leader): of each bucket ``DRAWS`` members are leaders, and a node keeps the
    ``TRIES`` leaders that it shares most buckets with, which are likely to be the most similar."""
    drawn = [F.min_by("node", F.xxhash64("node", "bucket", F.lit(k))).alias(f"l{k}") for k in range(DRAWS)]
    leaders = placed.groupBy("bucket").agg(*drawn, F.count("*").alias("k")).where("k > 1").drop("k")
    each = placed.join(leaders, "bucket").select("node", F.explode(F.array(*[f"l{k}" for k in range(DRAWS)])).alias("leader"))
    counted = each.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("k"))
    # A node has DRAWS leaders in each of its buckets at most, so its window is small.
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), "leader"))
    return counted.withColumn("place", place).where(F.col("place") <= TRIES).select("node", "leader")


def _split(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of the buckets that hold several components, with the component."""
    found = connected_components(links)
    own = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return own.join(several, "bucket")


def _closest(split: DataFrame, signs: DataFrame, number: int, small: int) -> DataFrame:
    """Pairs(a, b) of each class with up to ``TRIES`` of the members that its buckets draw from other components, those
    whose last bits are closest."""
    draw = [F.min_by(F.struct("node", "component"), F.xxhash64("node", "bucket", F.lit(DRAWS * (number + 1) + k))) for k in range(DRAWS)]
    leaders = split.groupBy("bucket").agg(F.array(*draw).alias("drawn"))
    each = split.join(leaders, "bucket").select("node", "component", F.explode("drawn").alias("l")).where("l.component <> component").select(
        F.col("node").alias("a"), F.col("l.node").alias("b")).distinct()
    side = lambda s: signs.select(*[F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in signs.columns])
    near = each.join(side("a"), "a").join(side("b"), "b").where(_may_link(small)).select("a", "b", F.expr(_unlike()).alias("unlike"))
    # A class has DRAWS leaders in each of its buckets at most, so its window is small.
    place = F.row_number().over(Window.partitionBy("a").orderBy("unlike", "b"))
    return near.withColumn("place", place).where(F.col("place") <= TRIES).select("a", "b")


def _unlike() -> str:
    return " + ".join(f"bit_count(bits{k}_a ^ bits{k}_b)" for k in range(BIT_WORDS))


def _may_link(small: int) -> str:
    """Exact bounds by the sizes and the common shingles, and the last bits: registers that differ do so in their last bit
    half of the time."""
    chance = (1 - small / 100) / 2
    most = math.ceil(_MANY * chance + SIGMAS * math.sqrt(_MANY * chance * (1 - chance)))
    return (f"100 * least(n_a, n_b) >= {small} * greatest(n_a, n_b) AND {small + 100} * least(common_a, common_b) >= {small} * (n_a + n_b) "
            f"AND {_unlike()} <= {most}")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b: products of 0/1 matrices over the elements that both sides
    have, a block of elements at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(all_a, all_b)
    place_a, place_b = np.searchsorted(both, all_a), np.searchsorted(both, all_b)
    in_a, in_b = (np.flatnonzero((p < len(both)) & (both[np.minimum(p, len(both) - 1)] == x)) if len(both) else np.zeros(0, int)
                  for p, x in ((place_a, all_a), (place_b, all_b)))
    for at in range(0, len(both), COLUMNS):
        ones = []
        for rows, place, known, size in ((rows_a, place_a, in_a, len(a)), (rows_b, place_b, in_b, len(b))):
            here = known[(place[known] >= at) & (place[known] < at + COLUMNS)]
            block = np.zeros((size, min(COLUMNS, len(both) - at)), np.float32)
            block[rows[here], place[here] - at] = 1
            ones.append(block)
        out += ones[0] @ ones[1].T
    return out


def _cell(rows: pd.DataFrame, small: int) -> pd.DataFrame:
    """The links between the two sides of a cell (or within its only side) that join different components: one for each pair
    of components, which connects what all of them would."""
    one = rows[rows["side"] == 0].reset_index(drop=True)
    other = rows[rows["side"] == 1].reset_index(drop=True)
    if not len(one) or not len(other) and rows["i"].iloc[0] != rows["j"].iloc[0]:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    other = other if len(other) else one
    sets = [[np.frombuffer(x, np.uint64) for x in side["members"]] for side in (one, other)]
    n, m = one["n"].to_numpy(float), other["n"].to_numpy(float)
    close = (100 + small) * overlaps(*sets).astype(np.float64) >= small * (n[:, None] + m[None, :])
    i, j = np.nonzero(close & (one["component"].to_numpy()[:, None] != other["component"].to_numpy()[None, :]))
    found = pd.DataFrame({"a": one["node"].to_numpy()[i], "b": other["node"].to_numpy()[j], "c": one["component"].to_numpy()[i], "d": other["component"].to_numpy()[j]})
    return found.drop_duplicates(["c", "d"])[["a", "b"]].astype("int64")


def _areas(left: DataFrame) -> DataFrame:
    """left(bucket, node, component, main) -> the same with ``bucket`` replaced where that saves rows: buckets whose largest component is the
    same hold much the same classes, one for each band, so together they are one area in which each class stands once. Which of the two
    is less work is reckoned for each component; both compare every pair of a bucket."""
    chunks = lambda c: F.ceil(F.col(c) / F.lit(CHUNK))
    rows = F.col("mains") * chunks("others") + F.col("others") * (chunks("mains") + chunks("others"))
    other = (F.col("component") != F.col("main")).cast("long")
    counts = [F.sum(1 - other).alias("mains"), F.sum(other).alias("others")]
    apart = left.groupBy("main", "bucket").agg(*counts).groupBy("main").agg(F.sum(rows).alias("apart"))
    whole = left.select("main", "node", "component").distinct().groupBy("main").agg(*counts).select("main", rows.alias("whole"))
    merged = apart.join(whole, "main").where("whole <= apart").select("main", F.xxhash64(F.lit("main"), "main").alias("area"))
    return left.join(merged, "main", "left").select(F.coalesce("area", "bucket").alias("bucket"), "node", "component", "main").distinct()


def _in_chunks(left: DataFrame, sets: DataFrame, small: int) -> DataFrame:
    """Links(a, b) between the components of large buckets. A bucket's largest component is cut into chunks, its other
    classes too; each chunk of others meets all chunks, but the largest component never meets itself. A cell of two chunks
    is a task's work of bounded size, so neither a bucket nor its pairs are ever gathered."""
    dealt = stored(_areas(left), "areas")
    inside = F.col("component") == F.col("main")
    sizes = dealt.groupBy("bucket").agg(F.ceil(F.count_if(inside) / F.lit(CHUNK)).cast("int").alias("mains"),
                                        F.ceil(F.count_if(~inside) / F.lit(CHUNK)).cast("int").alias("others"))
    draw = F.xxhash64("bucket", "node")
    own = dealt.join(sizes, "bucket").select("bucket", "node", "component", F.when(inside, 0).otherwise(1).alias("role"), "mains", "others")
    own = own.withColumn("chunk", F.pmod(draw, F.when(F.col("role") == 0, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    to = lambda count: F.sequence(F.lit(0), count - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    chunk, zero, one = F.col("chunk"), F.lit(0), F.lit(1)
    cells = F.when(F.col("role") == 0, F.transform(to(F.col("others")), lambda j: cell("main", chunk, j, zero))).otherwise(F.concat(
        F.transform(to(F.col("mains")), lambda i: cell("main", i, chunk, one)),
        F.transform(to(F.col("others")), lambda u: cell("others", F.least(chunk, u), F.greatest(chunk, u), F.when(chunk <= u, zero).otherwise(one)))))
    placed = own.where("others > 0").select("bucket", "node", "component", F.explode(cells).alias("at")).select("bucket", "node", "component", "at.*")
    return placed.join(sets, "node").groupBy("bucket", "kind", "i", "j").applyInPandas(lambda rows: _cell(rows, small), "a long, b long").distinct()


def class_links(docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """classes(node, id, row, n, registers, bits, bands) -> links(a, b) that connect all that all similar pairs of classes would."""
    small = round(100 * similarity)
    placed = classes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    members = stored(placed.join(shared, "bucket"), "buckets")

    # Two bands at a time: who shares such a bucket is most likely similar.
    twice = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.explode(F.transform(
        "bands", lambda band, i: F.xxhash64(band, F.get("bands", (i + 1) % BANDS)))).alias("bucket"))
    tried = stored(_leaders(twice), "tried")
    # The one row of a class with the smallest key, or rows that are equal to it, whatever the key: null or in use twice.
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *_text_hashes(text))
    wanted = members.select("node").distinct().join(classes.select("node", "n", "row.high", "row.low", F.col("row.id").alias("its")), "node")
    sets = texts.join(wanted, ["high", "low"]).where(F.col("id").eqNullSafe(F.col("its"))).select("node", "n", "text").mapInPandas(
        lambda batches: _set_rows(batches, words), "node long, n long, members binary")
    sets = stored(sets.dropDuplicates(["node"]), "sets")
    links = stored(_confirmed(tried.select(F.col("node").alias("a"), F.col("leader").alias("b")), sets, similarity), "links")

    removed(tried)
    split = stored(_split(members, links), "split")
    removed(members)
    signs = classes.select("node", "n", *[f"bits{k}" for k in range(BIT_WORDS)])
    # What only one of the classes that are left has, none of them shares: that bounds every pair's overlap.
    alone = sets.join(split.select("node").distinct(), "node", "left_semi").mapInArrow(_exploded, "node long, shingle long").groupBy(
        "shingle").agg(F.min("node").alias("node"), F.count("*").alias("k")).where("k = 1").groupBy("node").agg(F.count("*").alias("alone"))
    signs = signs.join(split.select("node").distinct(), "node").join(alone, "node", "left").withColumn(
        "common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone").where(f"100 * common >= {small} * n")
    signs = stored(signs, "signs")
    for number in range(ROUNDS):
        tried = stored(_closest(split, signs, number, small), "tried")
        more = stored(links.union(_confirmed(tried, sets, similarity)), "links")
        again = stored(_split(split.select("bucket", "node"), more), "split")
        removed(tried, links, split)
        links, split = more, again
    parts = split.groupBy("bucket", "component").agg(F.count("*").alias("own"))
    sizes = parts.groupBy("bucket").agg(F.sum("own").alias("k"), F.max_by("component", F.struct("own", "component")).alias("main"))
    left = stored(split.join(sizes, "bucket").join(signs, "node"), "left")
    removed(split)
    whole = left
    found = _in_chunks(left.where(f"k > {PAIRED}").select("bucket", "node", "component", "main"), sets, small)
    left = left.where(f"k <= {PAIRED}").drop("k", "main")
    side = lambda s: left.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in left.columns if c != "bucket"])
    pairs = side("a").join(side("b"), "bucket").where(f"node_a < node_b AND component_a <> component_b AND {_may_link(small)}").select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").distinct()
    kept, signs = signs, classes.select("node", "registers")
    low = similarity - SIGMAS * math.sqrt(similarity * (1 - similarity) / ESTIMATE_REGISTERS)
    pairs = stored(
        pairs.join(signs.select(F.col("node").alias("a"), F.col("registers").alias("registers_a")), "a")
        .join(signs.select(F.col("node").alias("b"), F.col("registers").alias("registers_b")), "b")
        .where(_estimate("registers_a", "registers_b", "n_a", "n_b") >= low).select("a", "b"), "pairs")
    every = stored(links.union(found).union(_confirmed(pairs, sets, similarity)), "links")
    removed(links, kept, whole, pairs, sets)
    return every


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Key, n_shingles, component_id (smallest key that links reach) and kept (whether that is the key itself).

    ``similarity`` is a hundredth of a whole number and 0.8 at least: the bands are made for that."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity must be in 0.8 .. 1")
    drawn = stored(sketches(docs, key, text, words), "sketches")
    classes = stored(
        drawn.where("node IS NOT NULL").groupBy("node", "check").agg(
            F.min("id").alias("id"), F.min(F.struct("id", "high", "low")).alias("row"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands"),
            *[F.get(F.first("bits"), F.lit(k)).alias(f"bits{k}") for k in range(BIT_WORDS)]).drop("check"),
        "classes")
    rows = stored(drawn.select("id", "n", "node"), "rows")
    removed(drawn)  # registers and bands are in the classes
    found = connected_components(class_links(docs, classes, key, text, words, similarity))
    named = classes.select("node", "id").join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named")
    removed(classes)
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = named.join(smallest, "component").select("node", "component_id")
    rows = rows.join(of_class, "node", "left")
    own = F.coalesce(F.col("component_id"), F.col("id"))
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=2)
