"""Repair of conversations against a search backwards over all edits."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from lurewatch.llm import audits, catalog, conversations
from lurewatch.llm.common import table
from tests.llm import odd

SEEN = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
TURN = (2, 2, 3, 2)


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        yield "blank" if not SEEN.search(text) else "duplicate" if (role, text) in seen else "" if SEEN.findall(text)[-1] in ".!?" else "truncated"
        seen.add((role, text))


def solved(rows):
    fault = list(faults(rows))

    def edits(i, q):
        yield "I", 2, i, TURN[q]
        if i < len(rows):
            yield "D", 3, i + 1, q
            if fault[i] in ("", "truncated"):
                late, initial = fault[i] == "truncated", rows[i][2][:1]
                if initial in AFTER[q]:
                    yield "K", late, i + 1, AFTER[q][initial]
                yield "R", 2 + late, i + 1, TURN[q]

    togo = [[10**9] * 4 for _ in range(len(rows) + 1)]
    togo[-1][0] = togo[-1][3] = 0
    for i in range(len(rows), -1, -1):
        for _, q in itertools.product(range(5), range(4)):
            togo[i][q] = min([togo[i][q], *(c + togo[j][p] for _, c, j, p in edits(i, q))])
    i = q = 0
    audit, out = "", []
    while i < len(rows) or togo[i][q]:
        letter, _, j, p = min(e for e in edits(i, q) if e[1] + togo[e[2]][e[3]] == togo[i][q])
        audit += letter
        if letter != "D":
            role = rows[i][2] if letter == "K" else {2: "user", 3: "assistant"}[p]
            out.append(f"{role}:{'' if letter == 'I' else rows[i][3]}")
        i, q = j, p
    initials, turns = [r[2][:1] for r in rows], [r[1] for r in rows if r[1] is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), togo[0][0], audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plainly(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[0]]
    for row in damage(rows):
        groups[row[0]].append(row)
    return {conv: solved(sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))) for conv, own in groups.items()}


def check(turns, got):
    wanted = plainly([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert found == wanted


def test_query(spark, folder):
    check(table(spark, folder, "conversations"), catalog.queries()["op12_audit_dp"](spark, folder))


@pytest.mark.parametrize("segment", [1024, 7, 1])
def test_odd_table_in_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    turns = odd.conversations(spark)
    check(turns, conversations.digest(turns))
    assert conversations.digest(turns.limit(0)).collect() == []


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in conversations.Repair(turns).turns().orderBy("segment", "position").select("role", "text").collect()]
    # Dropping the greeting costs 3 and the duplicate 3, an answer 2; an inserted question for the greeting costs 2.
    assert got == [("user", ""), ("assistant", "Hello."), ("user", "Hi?"), ("assistant", "")]


@pytest.mark.parametrize("prime", [audits.PRIME, 2, 1])
def test_order_of_sequences(prime):
    """Any two sequences of edits of the same rows, also where rolling hashes meet."""
    held, draw = audits.Audits(prime), random.Random(1)
    nodes = []
    for _ in range(60):
        node, word = audits.Audits.ROOT, ""
        for _ in range(9):
            node, word = held.add(node, letter := draw.choice("DKR")), word + letter
            if draw.random() < 0.3 and len(word) < 9:
                node, word = held.add(node, "I"), word + "I"
        nodes.append((node, word))
    for (a, x), (b, y) in itertools.product(nodes, nodes):
        assert held.text(a) == x
        if not x.startswith(y) and not y.startswith(x):
            assert held.less(a, b) == (x < y)


def test_ancestors():
    held, node = audits.Audits(), audits.Audits.ROOT
    chain = [node] + [node := held.add(node, "D") for _ in range(300)]
    assert all(held.lifted(chain[-1], d) == chain[d] for d in range(301))
    assert max(map(len, held.up)) <= 10
