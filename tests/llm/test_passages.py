"""Repeated passages against a plain scan of all word runs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lurewatch.llm import catalog, oracles, substrings
from lurewatch.llm.common import table
from tests.compare import difference, duck
from tests.llm import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scanned(rows, window=20):
    first, words = {}, {}
    for at, (key, text) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        words[at] = key, WORD.findall(text or "")
        for s in range(len(words[at][1]) - window + 1):
            first.setdefault(tuple(words[at][1][s : s + window]), (key, s))
    out = []
    for key, own in words.values():
        gone = set()
        for s in range(len(own) - window + 1):
            if first[tuple(own[s : s + window])] != (key, s):
                gone.update(range(s, s + window))
        out.append((key, len(own), len(gone), " ".join(w for p, w in enumerate(own) if p not in gone)))
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return table(spark, folder, "documents")


@pytest.fixture(scope="module")
def wanted(docs):
    return scanned([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_query(spark, folder, wanted):
    got = plain(catalog.queries()["op11_de_bruijn"](spark, folder))
    assert got == sorted(((k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in wanted), key=repr)
    assert difference(catalog.queries()["op11_de_bruijn"](spark, folder), duck(folder), oracles.REPEATED_RUNS) is None


def test_runs_that_share_a_hash(docs, wanted):
    """With 14 bits almost every run meets a different one; the words decide."""
    assert plain(substrings.without_repeats(docs, bits=14)) == wanted


@pytest.mark.parametrize("window", [2, 5, 33])
def test_windows(spark, window):
    words = [f"w{(i * i) % 17}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:300])), (3, "a " * 90), (4, "b " + "a " * 40), (5, "a b " * 30), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(substrings.without_repeats(docs, window=window)) == scanned(rows, window)


def test_odd_table(spark):
    docs = odd.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert plain(substrings.without_repeats(docs)) == scanned(rows)
    assert substrings.digest(docs.limit(0)).collect() == []


def test_paths_of_a_hot_passage(spark):
    """A passage in a third of all documents is one path, however many hold it."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, (f"{passage} " if i % 3 == 0 else "") + " ".join(f"d{i}x{k}" for k in range(30))) for i in range(300)]
    spans = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in spans.select("start", "n_words").distinct().collect()} == {(0, 60)}
    assert spans.where("NOT later").count() == 1 and spans.count() == 100


def test_string_keys(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([("b", text), ("a", text + " end")], "name string, body string")
    got = substrings.without_repeats(docs, key="name", text="body").orderBy("name").select("name", "n_removed").collect()
    assert [tuple(r) for r in got] == [("a", 0), ("b", 25)]
    assert docs.select(F.count("*")).first()[0] == 2


def test_tables_go_before_the_last_exchange(spark, monkeypatch):
    """When occurrences are looked up, the seeds and the graph are gone from the disk."""
    from pathlib import Path

    held, left = {}, {}
    plain_stored = substrings.stored

    def watched(df, name):
        if name == "spans":
            left.update({n: any(Path(f.removeprefix("file://")).exists() for f in files) for n, files in held.items()})
        kept = plain_stored(df, name)
        held[name] = kept.inputFiles()
        return kept

    monkeypatch.setattr(substrings, "stored", watched)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, "a " + words), (2, "a " + words), (None, "b " + words)]
    found = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plain(found) == scanned(rows)
    assert held["classes"] and held["graph"] and left == {"classes": False, "runs": True, "graph": False, "paths": True}
