"""SentencePiece encoding by sampling, and lossless decoding.

A text is cut before its words, as SentencePiece does, and each part has a lattice of vocabulary pieces; a character that
no piece covers is spelled in byte pieces. Forward filtering sums the weights of all segmentations up to every position;
backward sampling then draws one piece after the other from the end, in proportion to those sums. The draws are a hash of
the row key, the part's place in the text and the step, so a row gets the same pieces wherever and however often it runs.

The vocabulary is a public file, its path a parameter; it is never trained here. Its weights are Zipf weights of the
piece ranks to the power ``theta`` (higher: nearer to the single best segmentation). One narrow pass over whole texts, a
batch of rows at a time: a task keeps the lattices of the parts that it met last, so a part that comes again is not filtered
again, and all parts of a batch are drawn side by side.

Defined results: a null text has null pieces and n_pieces 0; an empty text has no pieces; both count as lossless.
Repeated rows get equal pieces; a null key counts as the text "None"; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from lurewatch.llm.common import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA, SEED = 1.0, 0
#: Texts are sampled together up to about so many characters, which bounds the lattices in memory.
TOGETHER = 120_000
#: A task keeps the lattices of parts of about so many characters; beyond that it begins afresh. This changes no result.
KEPT = 1_600_000
_PARTS = re.compile(r" ?[^ \n\t\r]+|[ \n\t\r]+")
_SPACE, _COVER = "▁", (1 << 21) - 1  # a literal space mark in the text is no piece
_GOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Vocabulary:
    """The pieces as a trie: ``keys`` holds node << 21 | code point in order, the child of entry k is node k + 1, and
    ``ends`` gives the piece that a node spells, or -1. ``slots`` holds the entries by a hash of their keys (-1: none)."""

    keys: np.ndarray
    slots: np.ndarray
    ends: np.ndarray
    weights: np.ndarray
    byte_ids: list[int]
    spelled: list[bytes]
    longest: int

    @cached_property
    def least(self) -> float:
        """The weight of a character that no piece covers."""
        return self.weights[self.weights > 0].min(initial=1.0) * 1e-3

    @cached_property
    def lifts(self) -> np.ndarray:
        """The factors of a piece by its number of characters."""
        used = self.weights[self.weights > 0]
        return np.array([(float(np.median(used) ** -0.4) if len(used) else 1.0) ** size for size in range(self.longest + 1)])

    def entries(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = _slot(key, len(self.slots))
        entry = self.slots[slot]
        open_ = np.flatnonzero((entry >= 0) & (self.keys[entry] != key))
        while len(open_):  # another key has the slot: the next one
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            entry[open_] = self.slots[slot[open_]]
            open_ = open_[(entry[open_] >= 0) & (self.keys[entry[open_]] != key[open_])]
        return entry


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * _GOLD) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _slots(keys: np.ndarray) -> np.ndarray:
    """A table of a power of two of slots, a quarter full at most; a key lies in the first free slot from its hash on."""
    slots = np.full(1 << (4 * len(keys) + 1).bit_length(), -1, np.int64)
    at, left = _slot(keys, len(slots)), np.arange(len(keys))
    while len(left):
        taken = slots[at[left]] >= 0
        slots[at[left[~taken][::-1]]] = left[~taken][::-1]  # the first of several
        left = left[slots[at[left]] != left]
        at[left] = (at[left] + 1) & (len(slots) - 1)
    return slots


def trie(pieces: dict[str, int], weights: np.ndarray, byte_ids: list[int], spelled: list[bytes]) -> Vocabulary:
    prefixes = sorted({name[:k] for name in pieces for k in range(1, len(name) + 1)}, key=lambda x: (len(x), x))
    # Nodes are numbered by depth, then by parent and character, so that the keys ascend with the nodes.
    number, level, keys, ends = {"": 0}, [], [], [-1]
    for depth in range(1, max(map(len, prefixes), default=0) + 1):
        level = sorted((number[x[:-1]], ord(x[-1]), x) for x in prefixes if len(x) == depth)
        for parent, point, x in level:
            number[x] = len(ends)
            keys.append(parent << 21 | point)
            ends.append(pieces.get(x, -1))
    held = np.array(keys, np.int64)
    return Vocabulary(held, _slots(held), np.array(ends, np.int32), weights, byte_ids, spelled, max(map(len, pieces), default=1))


def vocabulary(model: str = MODEL, theta: float = THETA) -> Vocabulary:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    byte_ids, pieces, spelled, weights = [0] * 256, {}, [], np.zeros(len(names))
    norm = sum(1 / rank for rank in range(1, len(names) + 1))
    for i, name in enumerate(names):
        if own.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            spelled.append(bytes([int(name[3:5], 16)]))
        elif own.is_control(i) or own.is_unknown(i):
            spelled.append(b"")
        else:
            pieces[name] = i
            weights[i] = (1 / (norm * len(pieces))) ** theta
            spelled.append(name.replace(_SPACE, " ").encode())
    return trie(pieces, weights, byte_ids, spelled)


def decode(ids, spelled: list[bytes]) -> str:
    return b"".join([spelled[i] for i in ids]).decode("utf-8")


def _order(numbers: np.ndarray) -> np.ndarray:
    """A stable order; short numbers are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if numbers.max(initial=0) < 1 << 16 else numbers, kind="stable")


class Lattices:
    """The positions ("states") of some distinct parts, numbered from ``first``. The edges of a state are the pieces that may
    end there, in the order of states, the longest last; their cumulative backward probabilities plus the number of the state ascend
    over the whole array. ``tops`` holds each state's last edge, counted from the first edge here; the edge for a draw is there or
    a few before. Piece -1 - c stands for the bytes of code point c."""

    def __init__(self, words: Vocabulary, parts: list[str], first: int = 0):
        joined = "".join(parts)
        plain = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        points = np.where(plain == ord(" "), ord(_SPACE), np.where(plain == ord(_SPACE), _COVER, plain))
        sizes = np.array([len(p) for p in parts], np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)
        stops = np.cumsum(sizes)
        states = len(joined) + len(parts)
        self.starts = np.zeros(states, bool)
        self.starts[stops - sizes + np.arange(len(parts))] = True
        self.ends = stops + np.arange(len(parts))

        at, node, found = np.arange(len(joined)), np.zeros(len(joined), np.int64), []
        stop, covered = stops[part], np.zeros(len(joined), bool)
        for size in range(1, words.longest + 1):
            key = node << 21 | points[at + size - 1]
            entry = words.entries(key)
            alive = entry >= 0
            at, node = at[alive], entry[alive] + 1
            piece = words.ends[node]
            spelled = piece >= 0
            found.append((at[spelled], np.full(int(spelled.sum()), size), piece[spelled].astype(np.int64)))
            if size == 1:
                covered[at[spelled]] = True
            room = at + size < stop[at]
            at, node = at[room], node[room]
            if not len(at):
                break
        bare = np.flatnonzero(~covered)  # no piece is this character: its bytes are an edge
        found.append((bare, np.ones(len(bare), np.int64), -1 - plain[bare]))
        begin, size, piece = (np.concatenate(x) for x in zip(*found))
        # A factor per character keeps the sums of usual parts near 1; it cancels in every ratio that is taken.
        weight = np.where(piece >= 0, words.weights[np.maximum(piece, 0)], words.least) * words.lifts[size]
        source = begin + part[begin]
        target = source + size
        order = _order(target)
        self.sources, target, self.pieces, weight = source[order], target[order], piece[order], weight[order]
        offset = target - (stops - sizes + np.arange(len(parts)))[part[begin[order]]]
        self.tops = np.cumsum(np.bincount(target, minlength=states)) - 1
        self.bounds = self._forward(words, target, offset, weight, states, sizes, stops, first)
        self.sources += first
        self.ends += first

    def _forward(self, words, target, offset, weight, states, sizes, stops, first) -> np.ndarray:
        sums, bounds = np.zeros(states), np.zeros(len(target))
        sums[self.starts] = 1.0
        first_state = stops - sizes + np.arange(len(sizes))
        by_offset = _order(offset)
        cuts = np.searchsorted(offset[by_offset], np.arange(1, int(sizes.max(initial=0)) + 2))
        for j in range(1, len(cuts)):
            edges = by_offset[cuts[j - 1] : cuts[j]]
            to = target[edges]
            mass = sums[self.sources[edges]] * weight[edges]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            totals = np.add.reduceat(mass, heads)
            group = np.cumsum(np.concatenate([[0], (to[1:] != to[:-1]).astype(np.int64)]))
            share = mass / totals[group]
            upto = np.cumsum(share)
            upto -= (upto[heads] - share[heads])[group]
            upto[np.concatenate([heads[1:] - 1, [len(to) - 1]])] = 1.0
            bounds[edges] = (to + first) + np.clip(upto, 0.0, 1.0)
            sums[to[heads]] = totals
            if j % 32 == 0:  # long parts: divide the sums that are still needed by the newest one
                long = first_state[sizes > j] + j
                newest = sums[long].copy()
                for back in range(min(words.longest, j) + 1):
                    sums[long - back] /= newest
        return bounds


class Kept:
    """Lattices one after another, each part's filtered when it is first met: a sequence of arrays that grow by doubling."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self._begin()

    def _begin(self) -> None:
        self.end_of: dict[str, int] = {}
        self.states, self.edges = 0, 1  # before the first edge stands one of no state, whose bound no draw is below
        self.starts, self.tops = np.zeros(0, bool), np.zeros(0, np.int64)
        self.sources, self.pieces, self.bounds = (np.zeros(1, kind) for kind in (np.int32, np.int32, float))

    def _grown(self, name: str, used: int, more: np.ndarray) -> None:
        own = getattr(self, name)
        if used + len(more) > len(own):
            own = np.concatenate([own[:used], more, np.zeros(used and used + len(more), own.dtype)])
            setattr(self, name, own)
        own[used : used + len(more)] = more

    def ends(self, parts: list[str]) -> np.ndarray:
        """The last state of each part's lattice."""
        found = np.fromiter(map(self.end_of.get, parts, repeat(-1)), np.int64, len(parts))
        open_ = np.flatnonzero(found < 0)
        new = list(dict.fromkeys([parts[k] for k in open_.tolist()]))
        if new and self.states and self.states + sum(map(len, new)) > KEPT:
            self._begin()
            return self.ends(parts)
        if new:
            more = Lattices(self.words, new, self.states)
            self.end_of.update(zip(new, more.ends.tolist()))
            self._grown("starts", self.states, more.starts)
            self._grown("tops", self.states, more.tops + self.edges)
            for name in ("sources", "pieces", "bounds"):
                self._grown(name, self.edges, getattr(more, name))
            self.states, self.edges = self.states + len(more.starts), self.edges + len(more.bounds)
            found[open_] = [self.end_of[parts[k]] for k in open_.tolist()]
        return found

    def edge(self, state: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Of each state the first edge whose bound is above the draw. Most draws are of its last edge or the one before, so they are
        walked to from there."""
        points, edge = state + draws, self.tops[state]
        open_ = np.flatnonzero(self.bounds[edge - 1] > points)
        while len(open_):
            before = edge[open_] - 1
            edge[open_] = before
            open_ = open_[self.bounds[before - 1] > points[open_]]
        return edge


def _draws(seeds: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from a counter."""
    with np.errstate(over="ignore"):
        x = seeds + _STEP * np.uint64(step + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _with_bytes(ids: np.ndarray, row: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Replaces the code points that stand for bytes by their byte pieces."""
    bare = np.flatnonzero(ids < 0)
    spelled = {int(i): [words.byte_ids[b] for b in chr(-1 - int(i)).encode()] for i in np.unique(ids[bare])}
    times = np.ones(len(ids), np.int64)
    times[bare] = [len(spelled[int(i)]) for i in ids[bare]]
    at = (np.cumsum(times) - times)[bare]
    out = np.repeat(ids, times)
    for start, i in zip(at, ids[bare]):
        own = spelled[int(i)]
        out[start : start + len(own)] = own
    return out, np.repeat(row, times)


def _drawn(lattices: Kept, parts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all parts after one another, and the number of pieces of each part."""
    who, state, step, drawn = np.arange(len(parts)), lattices.ends(parts), 0, []
    lengths, left = np.zeros(len(parts), np.int64), seeds
    while len(who):
        edge = lattices.edge(state, _draws(left, step))
        drawn.append((who, lattices.pieces[edge]))
        lengths[who] += 1
        state = lattices.sources[edge]
        going = ~lattices.starts[state]
        who, state, left, step = who[going], state[going], left[going], step + 1
    stops = np.cumsum(lengths)
    ids = np.zeros(int(stops[-1]), np.int64)
    for k, (who, one) in enumerate(drawn):
        ids[stops[who] - 1 - k] = one
    return ids, lengths


def sample(words: Vocabulary, keys: list, texts: list[str], seed: int = SEED, kept: Kept | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts after one another, and the number of pieces of each text. Parts are worked off in runs of
    about TOGETHER characters, so a long text takes no more memory than short ones."""
    split = [_PARTS.findall(text) for text in texts]
    counts = np.array([len(own) for own in split], np.int64)
    parts = [part for own in split for part in own]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
    seeds = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}") for k in keys], np.uint64)
    with np.errstate(over="ignore"):
        seeds = seeds[row] + _GOLD * place.astype(np.uint64)
    runs = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(parts)]
    kept = kept or Kept(words)
    found = [_drawn(kept, parts[a:b], seeds[a:b]) for a, b in zip(cuts, cuts[1:])]
    ids, row = np.concatenate([x for x, _ in found]), np.repeat(row, np.concatenate([x for _, x in found]))
    if (ids < 0).any():
        ids, row = _with_bytes(ids, row, words)
    return ids.astype(np.int32), np.bincount(row, minlength=len(texts)).astype(np.int64)


def _cut(lengths: list[int | None]) -> Iterator[slice]:
    """Runs of rows of about TOGETHER characters."""
    start = size = 0
    for i, length in enumerate(lengths):
        size += length or 0
        if size >= TOGETHER or i + 1 == len(lengths):
            yield slice(start, i + 1)
            start, size = i + 1, 0


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, theta: float = THETA, seed: int = SEED,
           carry: tuple[str, ...] = ()) -> DataFrame:
    """Key, n_pieces, pieces (ids) and whether decoding them gave the text back; columns to carry come last, unread."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(model, theta))  # bounded by the vocabulary file
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        spelled, kept = words.spelled, Kept(words)
        for whole in batches:
            for rows in _cut(pc.utf8_length(whole.column(1)).to_pylist()):
                batch = whole.slice(rows.start, rows.stop - rows.start)
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                ids, counts = sample(words, keys.to_pylist(), [x or "" for x in texts], seed, kept)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                same = [x is None or decode(ids[a:b].tolist(), spelled) == x for x, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist())]
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array([x is None for x in texts], pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(counts), lists, pa.array(same, pa.bool_()), *batch.columns[2:]], names=[key, "n_pieces", "pieces", "lossless", *carry])
            give_back()

    others = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(key, text, *carry).mapInArrow(run, f"`{key}` {kind}, n_pieces long, pieces array<int>, lossless boolean{others}")


def decoded(encoded: DataFrame, pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """Adds column ``decoded``: the text of the pieces."""
    import pandas as pd
    from pyspark.sql import functions as F

    held = encoded.sparkSession.sparkContext.broadcast(vocabulary(model).spelled)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else decode(ids, held.value))

    return encoded.withColumn("decoded", F.pandas_udf(run, "string")(F.col(pieces)))


def digest(docs: DataFrame) -> DataFrame:
    return encode(docs)
