"""Removal of long passages that occur earlier, by a compacted De Bruijn graph of the words.

The runs of ``window`` words are the edges of the graph, the runs of one word less its nodes. A word goes when a run that covers it
also occurs earlier: in a document with a smaller key, or further up in the same one.

1. Documents with the same text are one class. In all but the first every run occurs earlier, so only classes go on. They are
   laid out by their smallest key, then by hash; a run's ``place`` is its first word's number in that order.
2. A run that occurs twice has the same smallest hash of its short runs ("seed") both times. Seeds, about one for seven words, show
   which runs can repeat at all; no other run leaves its document.
3. Edges that occur at two places or more stay. One that is always followed by the same edge, which occurs as often, is joined to it:
   such nonbranching stretches become paths, cut at multiples of ``STRETCH`` places. Wherever a path's first edge occurs, all of it
   does, so occurrences are looked up for first edges alone.
4. The words of every occurrence of a path are hashed with 128 bits where they stand. If those of a path differ (two runs had one
   64-bit hash), its runs are judged one by one by the SHA-256 of their words.

Defined results: a null or empty text has no words and keeps none; a text with fewer words than a window keeps all. Repeated rows
(same key, same text) have the same result each; of rows with the same key and another text, that with the smaller hash counts as earlier.
A null key is smaller than all others. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import give_back, removed, stored
from lurewatch.llm.hashing import forget, run_hashes, run_maxima, run_minima, split_words, word_hashes
from lurewatch.llm.numbering import placed

WINDOW = 20
#: A path lies within one stretch of so many places: whoever collects a path's edges holds a bounded group.
STRETCH = 4096
#: Bits of an edge's hash; tests use few to make different runs meet.
EDGE_BITS = 64
LONGS = pa.list_(pa.int64())


def _seed_words(window: int) -> int:
    return max(1, 2 * window // 5)


def _seeds(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the smallest hash of its short runs; the sorted hashes of the short runs that are the smallest of a window; and
    those of them that stand at several places."""
    short = run_hashes(hashes, _seed_words(window))
    width = window - _seed_words(window) + 1
    least = run_minima(short, width)
    if not len(least):
        return least, least, least
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    chosen = np.sort(short[short == run_maxima(around, width)])
    again = chosen[1:] == chosen[:-1]
    return least, chosen[np.append(True, ~again)], np.unique(chosen[1:][again])


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def _drawn(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of texts with a window: the batch's columns but the text, n, again and seeds."""
    for batch in batches:
        rows, count, again, seeds = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = split_words(text)
            if len(words) < window:
                continue
            _, own, twice = _seeds(word_hashes(words), window)
            rows.append(i)
            count.append(len(words))
            again.append(bool(len(twice)))
            seeds.append(own.view(np.int64))
        kept = batch.select(["id", "high", "low"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(count, pa.int64()), pa.array(again, pa.bool_()), pa.array(seeds, LONGS)], names=["id", "high", "low", "n", "again", "seeds"])
    forget()
    give_back()


def _candidates(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The runs of a class that can repeat, as starts and edge hashes."""
    for batch in batches:
        starts, edges = [], []
        for text, hot in zip(batch.column("text").to_pylist(), batch.column("hot").to_pylist()):
            hashes = word_hashes(split_words(text))
            least, _, twice = _seeds(hashes, window)
            wanted = np.union1d(np.array(hot or [], np.int64).view(np.uint64), twice)
            turns = np.append(True, least[1:] != least[:-1])  # a seed is that of several windows in turn
            lengths = np.diff(np.append(np.flatnonzero(turns), len(least)))
            at = np.flatnonzero(np.repeat(np.isin(least[turns], wanted), lengths))
            starts.append(at.astype(np.int64))
            edges.append((run_hashes(hashes, window)[at] >> np.uint64(64 - bits)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("place"), pa.array(starts, LONGS), pa.array(edges, LONGS)], names=["node", "place", "starts", "edges"])
    forget()
    give_back()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each candidate run: its edge, the edge after it (null unless that is a candidate), where it is."""
    for batch in batches:
        for i in range(batch.num_rows):
            starts, edges = (batch.column(c)[i].values.to_numpy() for c in ("starts", "edges"))
            follows = np.append(starts[1:] == starts[:-1] + 1, False) if len(starts) else np.zeros(0, bool)
            after = pa.array(np.append(edges[1:], 0) if len(edges) else edges, mask=~follows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(edges), after, pa.array(starts + batch.column("place")[i].as_py()), pa.array(np.full(len(edges), batch.column("node")[i].as_py())), pa.array(starts)],
                names=["edge", "after", "place", "node", "start"])


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words that stay, and a hash of each path where it occurs."""
    for batch in batches:
        counts, gone, kept, checks = [], [], [], []
        for text, copy, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "spans"))):
            words, found, left = split_words(text), [], []
            counts.append(len(words))
            if not copy:
                covered, reach = [], 0
                for span in spans or []:
                    end = span["start"] + span["length"] + window - 1
                    high, low = _halves(xxhash.xxh3_128_digest(b" ".join(words[span["start"] : end])))
                    found.append({"path": span["path"], "high": high, "low": low})
                    if span["later"]:
                        covered.append((span["start"], end))
                for start, end in sorted(covered):
                    left += words[reach:start]
                    reach = max(reach, end)
                left = left + words[reach:] if reach else words
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
            checks.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
             pa.array(checks, pa.list_(pa.struct([("path", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])))], names=["id", "n_words", "n_removed", "kept", "checks"])
    give_back()


def _spelled(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the words of single runs."""
    for batch in batches:
        for node, place, text, starts in zip(*(batch.column(c).to_pylist() for c in ("node", "place", "text", "starts"))):
            words = split_words(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(b" ".join(words[s : s + window])).digest() for s in starts], pa.binary()), pa.array([node] * len(starts), pa.int64()),
                 pa.array(starts, pa.int64()), pa.array([place + s for s in starts], pa.int64())], names=["words", "node", "start", "place"])


def _with(function, *parameters):
    """A function of batches alone; it carries plain values to the workers, no tables."""
    return lambda batches: function(batches, *parameters)


class _Corpus:
    """The classes of a table's texts that have a window: nodes with their smallest key, their place and their seeds."""

    def __init__(self, docs: DataFrame, key: str, text: str, window: int):
        self.window = window
        both = [F.xxhash64(F.lit(k), F.coalesce(F.col(text), F.lit(""))).alias(name) for k, name in enumerate(("high", "low"))]
        self.texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *both)
        self.kind = docs.schema[key].dataType.simpleString()
        drawn = self.texts.mapInArrow(_with(_drawn, window), f"id {self.kind}, high long, low long, n long, again boolean, seeds array<long>")
        one = drawn.groupBy("high", "low").agg(
            F.min(F.struct("id")).alias("first"), F.first("n").alias("n"), F.first("again").alias("again"), F.first("seeds").alias("seeds"))
        self.seeded = stored(one.withColumn("node", F.monotonically_increasing_id()), "classes")
        self.classes = placed(self.seeded.select("node", "high", "low", "first", "again", "n"), ["first", "high", "low"], "n", "places")

    def first_texts(self, wanted: DataFrame) -> DataFrame:
        """wanted(node, ..) with place and text; a repeated row gives its class twice."""
        classes = self.classes.select("node", "place", "first", "high", "low").join(wanted, "node")
        return self.texts.join(classes, ["high", "low"]).where(F.col("id").eqNullSafe(F.col("first.id"))).drop("id", "first", "high", "low")


def _graph(edges: DataFrame) -> DataFrame:
    """occurrences(edge, after, place) -> the edges at several places: how often and where first they occur, and ``after`` where it
    is the same for all occurrences."""
    return edges.groupBy("edge").agg(
        F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.min("after").alias("low"), F.max("after").alias("high"),
        F.count("after").alias("followed")).where("first < last").select(
            "edge", "n", "first", F.expr("CASE WHEN low = high AND followed = n THEN low END").alias("after"))


def _paths(graph: DataFrame) -> DataFrame:
    """The first edge of each path, the place where it first occurs and its number of edges."""
    # An edge that always leads to ``after``, which occurs as often: then every occurrence of it follows one of the edge.
    joined = graph.where("after IS NOT NULL").select(F.col("after").alias("edge"), "n", (F.col("first") + 1).alias("first"), F.lit(True).alias("joined"))
    heads = graph.join(joined, ["edge", "n", "first"], "left").select(
        "edge", "first", (F.col("joined").isNull() | (F.col("first") % STRETCH == 0)).alias("head"), F.floor(F.col("first") / STRETCH).alias("stretch"))
    listed = F.array_sort(F.collect_list(F.struct("first", "edge", "head")))
    # The edges of a stretch, STRETCH at most, in order: a path reaches up to the next head.
    at = heads.groupBy("stretch").agg(listed.alias("edges")).select("edges", F.expr("filter(sequence(0, size(edges) - 1), i -> edges[i].head)").alias("heads"))
    return at.select("edges", F.expr("size(edges)").alias("n"), "heads", F.posexplode("heads").alias("k", "i")).select(
        F.expr("edges[i].edge").alias("edge"), F.expr("edges[i].first").alias("path"),
        (F.coalesce(F.expr("get(heads, k + 1)"), F.col("n")) - F.col("i")).cast("long").alias("length"))


def _spans(corpus: _Corpus, bits: int) -> DataFrame:
    """(node, start, length, path, later): where repeated paths occur, and whether the path occurs earlier."""
    seeds = corpus.seeded.select("node", F.explode("seeds").alias("seed"))
    common = seeds.groupBy("seed").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("seed")
    hot = seeds.join(common, "seed").groupBy("node").agg(F.collect_list("seed").alias("hot"))
    wanted = corpus.seeded.select("node", "again").join(hot, "node", "left").where("again OR hot IS NOT NULL").drop("again")
    runs = stored(corpus.first_texts(wanted).mapInArrow(
        _with(_candidates, corpus.window, bits), "node long, place long, starts array<long>, edges array<long>"), "runs")
    removed(corpus.seeded)  # tables go as soon as nothing reads them
    every = runs.mapInArrow(_occurrences, "edge long, after long, place long, node long, start long")
    graph = stored(_graph(every.select("edge", "after", "place")), "graph")
    paths = stored(_paths(graph), "paths")
    removed(graph)
    found = stored(every.select("edge", "place", "node", "start").join(paths, "edge").select(
        "node", "start", "length", "path", (F.col("place") > F.col("path")).alias("later")), "spans")
    removed(runs, paths)
    return found


def _answers(corpus: _Corpus, spans: DataFrame) -> DataFrame:
    """A row for each row of the table: id, n_words, n_removed, kept, checks."""
    listed = spans.groupBy("node").agg(F.collect_set(F.struct("start", "length", "path", "later")).alias("spans"))
    classes = corpus.classes.select("node", "high", "low", "first").join(listed, "node", "left").drop("node")
    rows = corpus.texts.join(classes, ["high", "low"], "left").select(
        "id", "text", (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))).alias("copy"), "spans")
    return rows.mapInArrow(
        _with(_kept, corpus.window),
        f"id {corpus.kind}, n_words long, n_removed long, kept string, checks array<struct<path:long,high:long,low:long>>")


def _one_by_one(corpus: _Corpus, spans: DataFrame, doubtful: DataFrame) -> DataFrame:
    """The spans, those of doubtful paths as single runs that are judged by their words."""
    single = spans.join(doubtful, "path").select("node", F.explode(F.expr("sequence(start, start + length - 1)")).alias("start")).distinct()
    wanted = single.groupBy("node").agg(F.collect_list("start").alias("starts"))
    spelled = stored(corpus.first_texts(wanted).mapInArrow(
        _with(_spelled, corpus.window), "words binary, node long, start long, place long").distinct(), "spelled")
    first = spelled.groupBy("words").agg(F.min("place").alias("path"))
    judged = spelled.join(first, "words").select("node", "start", F.lit(1).cast("long").alias("length"), "path", (F.col("place") > F.col("path")).alias("later"))
    return spans.join(doubtful, "path", "left_anti").select("node", "start", "length", "path", "later").union(judged)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """Key, n_words, n_removed and kept: the words that stay, joined by one space."""
    corpus = _Corpus(docs, key, text, window)
    spans = _spans(corpus, bits or EDGE_BITS)
    found = stored(_answers(corpus, spans), "kept")
    each = found.select(F.explode("checks").alias("check")).select("check.*")
    differs = lambda c: F.min(c) < F.max(c)
    doubtful = each.groupBy("path").agg((differs("high") | differs("low")).alias("differs")).where("differs").select("path")
    if not doubtful.isEmpty():
        found = _answers(corpus, stored(_one_by_one(corpus, spans, stored(doubtful, "doubtful")), "spans"))
    return found.select(F.col("id").alias(key), "n_words", "n_removed", "kept")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Key, start, n_words, path and later: the repeated passages of the first document of each class, with the place that tells the
    passage; ``later`` where it also occurs earlier. Passages of one document may overlap."""
    corpus = _Corpus(docs, key, text, window)
    named = corpus.classes.select("node", F.col("first.id").alias(key))
    return _spans(corpus, EDGE_BITS).join(named, "node").select(key, "start", (F.col("length") + window - 1).alias("n_words"), "path", "later").distinct()


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))
