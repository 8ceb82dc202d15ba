"""Repair of conversations: faults, cheapest edits, and the audit of them.

A conversation is edited until its roles' initials read (s?(ua)+)?: rows are kept, reroled or deleted, empty turns inserted. A
forward pass holds the cheapest edits for each of four states; equally cheap ones are told apart by their audits, which are linked
nodes with shared beginnings (``audits.py``), so no audit is copied or compared letter by letter.

Rows that are equal in all columns are one row with a number of copies, before anything is dealt out. A conversation of more than
``SEGMENT`` such rows is worked off in segments, each for all four states that it may be entered in; a second pass puts the segments'
results together, and a third applies the audit to each segment. Only the audit itself, one string by contract, and the hash of the
repaired text pass through one task a conversation, a segment at a time.

Defined results: rows are taken by turn, nulls first, then by role and text. A null role or text is one space; a null conversation id
is an id like any other. Repeated rows are duplicates. The initial of an empty role is the empty string, which fits nowhere. An empty
table gives an empty result; other columns are ignored. Turns are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from lurewatch.llm.audits import EMPTY, Audits, Front, applied
from lurewatch.llm.common import give_back, stored
from lurewatch.llm.numbering import placed

SEGMENT = 1024
VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
LEGAL = {"su", "ua", "au"}


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the damage that the checksum of ``conv_id:turn`` asks for."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice).drop("copy")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that come sorted by ``names``, one group after the other."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[n] for n in names)
            if held and own != key:
                yield key, held
                held = []
            key = own
            held.append(row)
    if held:
        yield key, held


def _counted(rows: list[dict]) -> dict:
    out, before = dict.fromkeys(COUNTS, 0), None
    for row in rows:
        n, initial = row["n"], row["role"][:1]
        out["illegal"] += n - 1 + (before is not None and before + initial not in LEGAL)
        before = initial
        if row["blank"]:
            out["blank"] += n
        else:
            out["duplicate"] += n - bool(row["first"])
            out["truncated"] += bool(row["first"] and not row["ended"])
    return out | {"opening": rows[0]["role"][:1], "closing": before}


def _plain(rows: list[dict]) -> list[tuple[str, str, int]]:
    return [(r["role"], r["text"], r["n"]) for r in rows]


def _edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The cheapest edits of each segment, from each state that it may be entered in."""
    for (conv, segment), rows in _groups(batches, ["conv", "segment"]):
        whole = rows[0]["segments"] == 1
        about = _counted(rows) | {"conv": conv, "segment": segment, "whole": whole}
        out = []
        for entry in range(4) if segment else (EMPTY,):
            audits = Audits()
            front = Front(audits, entry)
            for row in rows:
                front.row(row["role"][:1], row["blank"] or not row["first"], not row["ended"], row["n"])
            if whole:
                cost, node = front.end()
                audit = audits.text(node)
                out.append(about | {"entry": entry, "leaves": entry, "cost": cost, "audit": audit, "turns": applied(_plain(rows), audit, EMPTY)[0]})
            else:
                out += [about | {"entry": entry, "leaves": q, "cost": held[0], "audit": audits.text(held[1]), "turns": None} for q, held in enumerate(front.best) if held]
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    give_back()


def _put_together(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The audits of long conversations, a row for each segment: its part and the state it is entered in. What is inserted at the
    very end, and the sums, stand with the last segment."""
    held_conv, audits, front, sums, entries = None, None, None, None, None

    def finished() -> pa.RecordBatch:
        cost, node = front.end()
        parts = audits.elements(node)
        last = "".join(parts[entries:])
        parts = parts[:entries]
        state, out = EMPTY, []
        for i, part in enumerate(parts):
            final = i == len(parts) - 1
            out.append({"conv": held_conv[0], "segment": i, "entry": state, "audit": part[:-1] + (last if final else ""), "cost": cost if final else None,
                        **{c: sums[c] if final else None for c in COUNTS}})
            state = int(part[-1])
        return pa.RecordBatch.from_pylist(out, schema=schema)

    for (conv, _), rows in _groups(batches, ["conv", "segment"]):
        if held_conv != (conv,):
            if held_conv:
                yield finished()
            held_conv, audits, entries, sums = (conv,), Audits(), 0, dict.fromkeys(COUNTS, 0) | {"closing": None}
            front = Front(audits)
        # A part ends in the digit of the state that it leaves to; parts that differ do so before it.
        front.stretch([(r["entry"], r["leaves"], r["cost"], f"{r['audit']}{r['leaves']}") for r in rows])
        entries += 1
        for c in COUNTS:
            sums[c] += rows[0][c]
        sums["illegal"] += sums["closing"] is not None and sums["closing"] + rows[0]["opening"] not in LEGAL
        sums["closing"] = rows[0]["closing"]
    if held_conv:
        yield finished()
    give_back()


def _entered(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The repaired turns of the segments of long conversations. A segment's state at its entry follows from its audit alone."""
    for (conv, segment), rows in _groups(batches, ["conv", "segment"]):
        turns = applied(_plain(rows), rows[0]["audit"], rows[0]["entry"])[0]
        yield pa.RecordBatch.from_pylist([{"conv": conv, "segment": segment, "turns": turns}], schema=schema)
    give_back()


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of long conversations' repaired turns and their whole audit, a segment after the other."""
    held, digest, empty, audit, last = None, None, True, [], None

    def finished() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv": held[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest(),
                                            "cost": last["cost"], **{c: last[c] for c in COUNTS}}], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if held != (row["conv"],):
                if held:
                    yield finished()
                held, digest, empty, audit = (row["conv"],), hashlib.sha256(), True, []
            if row["turns"]:
                digest.update((b"" if empty else b"\n") + "\n".join(f"{t['role']}:{t['text']}" for t in row["turns"]).encode("utf-8", "surrogatepass"))
                empty = False
            audit.append(row["audit"])
            last = row
    if held:
        yield finished()
    give_back()


def _dealt(df: DataFrame, by: list[str], then: list[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *then)


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


class Repair:
    """The cheapest edits of the conversations of a table.

    ``about``: conv, gaps. ``whole``: conversations of one segment with counts, cost, audit and turns. ``parts``: for each segment of
    a long one its part of the audit; counts and cost of the conversation with the last."""

    def __init__(self, turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = turns.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"))
        self.kind = turns.schema[key].dataType.simpleString()
        self.arrow = to_arrow_type(turns.schema[key].dataType)
        counted = stored(rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("one", F.lit(1).cast("long")), "turns")
        numbered = placed(counted, ["conv", "turn", "role", "text"], "one", "ordered")
        firsts = numbered.groupBy("conv", "role", F.sha2(F.col("text").cast("binary"), 256).alias("text")).agg(F.min("place").alias("place")).select(
            "place", F.lit(True).alias("first"))
        span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        self.about = stored(numbered.groupBy("conv").agg(
            F.min("place").alias("start"), F.count("*").alias("rows"), F.coalesce(span, F.lit(0)).cast("long").alias("gaps")), "conversations")
        about = self.about.select(F.col("conv").alias("its"), "start", F.ceil(F.col("rows") / SEGMENT).alias("segments"))
        self.rows = stored(numbered.join(firsts, "place", "left").join(about, _same("conv", "its")).select(
            "conv", F.floor((F.col("place") - F.col("start")) / SEGMENT).alias("segment"), "segments", "place", "role", "text", "n",
            F.coalesce("first", F.lit(False)).alias("first"), (~F.col("text").rlike(VISIBLE)).alias("blank"), F.col("text").rlike(ENDED).alias("ended")), "segments")
        long, string = pa.int64(), pa.string()
        edited = self._mapped(_dealt(self.rows, ["conv", "segment"], ["place"]), _edited, [
            ("segment", long), ("whole", pa.bool_()), ("entry", long), ("leaves", long), ("cost", long), ("audit", string), ("turns", TURNS),
            *[(c, long) for c in COUNTS], ("opening", string), ("closing", string)])
        edited = stored(edited, "edited")
        self.whole = edited.where("whole")
        between = edited.where("NOT whole").drop("whole", "turns")
        self.parts = stored(self._mapped(_dealt(between, ["conv"], ["segment", "entry", "leaves"]), _put_together, [
            ("segment", long), ("entry", long), ("audit", string), ("cost", long), *[(c, long) for c in COUNTS]]), "audits")

    def _mapped(self, df: DataFrame, function, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
        schema = pa.schema([("conv", self.arrow), *fields])
        rest = from_arrow_schema(pa.schema(fields))
        kind = ", ".join([f"conv {self.kind}", *[f"{f.name} {f.dataType.simpleString()}" for f in rest]])
        return df.mapInArrow(lambda batches: function(batches, schema), kind)

    def long_turns(self) -> DataFrame:
        """(conv, segment, turns) of conversations of several segments."""
        mine = self.parts.select(F.col("conv").alias("its"), F.col("segment").alias("part"), "audit", "entry")
        rows = self.rows.where("segments > 1").join(mine, _same("conv", "its") & (F.col("segment") == F.col("part")))
        return self._mapped(_dealt(rows.select("conv", "segment", "place", "role", "text", "n", "audit", "entry"), ["conv", "segment"], ["place"]), _entered, [
            ("segment", pa.int64()), ("turns", TURNS)])

    def turns(self) -> DataFrame:
        """The repaired conversations: conv, segment, position within it, role, text."""
        every = self.whole.select("conv", "segment", "turns").union(self.long_turns())
        return every.select("conv", "segment", F.posexplode("turns").alias("position", "turn")).select("conv", "segment", "position", "turn.*")

    def report(self) -> DataFrame:
        """A row for each conversation that has rows: conv, gaps, counts, cost, audit, repaired_sha256."""
        lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        whole = self.whole.select("conv", "audit", "cost", *COUNTS, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
        mine = self.long_turns().select(F.col("conv").alias("its"), F.col("segment").alias("part"), "turns")
        both = self.parts.join(mine, _same("conv", "its") & (F.col("segment") == F.col("part"))).drop("its", "part", "entry")
        hashed = self._mapped(_dealt(both, ["conv"], ["segment"]), _hashed, [
            ("audit", pa.string()), ("repaired_sha256", pa.string()), ("cost", pa.int64()), *[(c, pa.int64()) for c in COUNTS]])
        found = whole.unionByName(hashed)
        return found.join(self.about.select(F.col("conv").alias("its"), "gaps"), _same("conv", "its")).drop("its")


def digest(turns: DataFrame) -> DataFrame:
    report = Repair(damaged(turns)).report()
    every = turns.select("conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(report, _same("conv_id", "conv"), "left").select(
        "conv_id", zero("gaps"), *map(zero, COUNTS), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
