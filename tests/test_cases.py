"""Routing of incidents, insert-or-update tables, mail files and lenient sources against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import casebook
from lurewatch.sources import mailfiles, records
from lurewatch.sources.keyed import KeyedTable, newest
from lurewatch.streaming import live

START = dt.datetime(2024, 1, 1)


def fold(evidence, campaigns, people):
    """Evidence (id, ts, employee, campaign) and containments one after the other; root per evidence, closed roots."""
    happenings = [(ts, 1, i, who, camp) for i, ts, who, camp in evidence]
    happenings += [(at, 0, -1, None, camp) for camp, at in campaigns] + [(at, 0, -1, who, None) for who, at in people]
    book, roots = {}, {}
    for _, kind, i, who, camp in sorted(happenings, key=lambda h: h[:3]):
        if kind == 0:
            for case in book.values():
                if (camp is not None and case["campaign"] == camp) or who in case["people"]:
                    case["open"] = False
            continue
        fits = [r for r, c in book.items() if c["open"] and (c["campaign"] == camp if camp else who in c["people"])]
        root = (fits[0] if camp else fits[-1]) if fits else i
        book.setdefault(root, {"open": True, "campaign": camp, "people": set()})["people"].add(who)
        roots[i] = root
    return roots, {r: (c["campaign"], "open" if c["open"] else "contained") for r, c in book.items()}


def test_casebook(spark):
    draw = random.Random(1)
    at = lambda: START + dt.timedelta(seconds=draw.randrange(10**6))
    evidence = [(i, at(), draw.choice([1, 1, 1, 2, 3, 4]), draw.choice([None, None, "camp-1", "camp-1", "camp-2"])) for i in range(40)]
    campaigns, people = [(f"camp-{draw.choice([1, 2])}", at()) for _ in range(2)], [(draw.randrange(1, 5), at())]
    exposures = spark.createDataFrame([(*e, 1 + e[0] % 3) for e in evidence], "evidence_id long, ts timestamp, employee_id long, campaign_id string, severity int")
    closings = spark.createDataFrame(campaigns, "campaign_id string, at timestamp"), spark.createDataFrame(people, "employee_id long, at timestamp")
    roots, book = fold(evidence, campaigns, people)
    routed = casebook.route(exposures, *closings)
    assert {r["evidence_id"]: r["root"] for r in routed.collect()} == roots
    found = casebook.book(exposures, routed, *closings).collect()
    assert {r["root"]: (r["campaign_id"], r["status"]) for r in found} == book
    assert sum(r["evidence"] for r in found) == len(evidence)


def test_casebook_of_nothing(spark):
    none = spark.createDataFrame([], "evidence_id long, ts timestamp, employee_id long, campaign_id string")
    closings = spark.createDataFrame([], "campaign_id string, at timestamp"), spark.createDataFrame([], "employee_id long, at timestamp")
    assert casebook.route(none, *closings).collect() == []


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id long, v string, seen int", ["id"], newest(["id"], ["seen"]), buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, "id long, v string, seen int")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert plain(table.read()) == []
    assert table.apply(batch([(1, "a", 0), (1, "b", 1), (2, "c", 0)]), 0) and plain(table.read()) == [(1, "b", 1), (2, "c", 0)]
    assert table.apply(batch([(2, "d", 2), (3, "e", 2), (1, "old", 0)]), 1)
    want = [(1, "b", 1), (2, "d", 2), (3, "e", 2)]
    assert plain(table.read()) == want and plain(table.before(1)) == [(1, "b", 1), (2, "c", 0)]
    assert not table.apply(batch([(9, "again", 9)]), 1) and plain(table.read()) == want  # a batch that comes again changes nothing
    assert table.apply(batch([]), 2) and plain(table.read()) == want
    (tmp_path / "t" / "batch=3" / "bucket=0").mkdir(parents=True)  # a batch that was cut off has no pointer
    assert plain(table.read()) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id long, v int", ["id"], newest(["id"], ["v"]))
    table.apply(spark.range(500).select("id", F.lit(0).alias("v")), 0)
    table.apply(spark.createDataFrame([(7, 1)], "id long, v int"), 1)
    assert len(list((tmp_path / "t" / "batch=0").glob("bucket=*"))) == 16 and len(list((tmp_path / "t" / "batch=1").glob("bucket=*"))) == 1
    assert table.read().where("v = 1").count() == 1 and table.read().count() == 500


def test_arrivals_restart(spark):
    """Each arrival is a restart of the stream; a step that is run twice with its batch gives its events once."""
    rows = spark.createDataFrame([(i, f"inc-{i % 3}", i % 4, 1 + i % 3) for i in range(40)], "evidence_id long, incident_id string, employee_id long, severity int").withColumn(
        "ts", F.lit(START))
    state, seen = live.incident_state(spark, "state"), []

    def step(batch, number):
        for _ in range(2):
            seen.append((number, batch.count()))
            state.apply(live.incident_parts(batch), number)

    live.arrivals(rows, F.col("evidence_id") % 5, [2, 0, 4, 1, 3], "arriving", step)
    assert seen == [(n, 8) for n in range(5) for _ in range(2)]
    got = {r["incident_id"]: (r["severity"], r["evidence"], r["affected"]) for r in live.incident_view(state).collect()}
    assert got == {"inc-0": (1, 14, 4), "inc-1": (2, 13, 4), "inc-2": (3, 13, 4)}


def test_changed_incidents(spark):
    old = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "incident_id string, severity int")
    new = spark.createDataFrame([("a", 2), ("b", 1), ("b", 3), ("c", 1)], "incident_id string, severity int")
    assert {tuple(r) for r in live.changed_incidents(new, old).collect()} == {
        ("incident.updated", "a"), ("incident.escalated", "b"), ("incident.created", "c")}


def test_mail_files(spark, tmp_path):
    html = '<p>Hi <a href="https://a.example/x">here</a> <a href="https://a.example/x">here</a> <a href="mailto:x@y.example">mail</a> <a href="www.b.example">b</a></p>'
    raw = (b'From: "A" <a@x.example>\r\nReply-To: <Other@y.example>\r\nTo: b@x.example\r\nSubject: s\r\nMessage-ID: <1@x>\r\nMIME-Version: 1.0\r\n'
           b"Content-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain; charset=no-such-set\r\n\r\n"
           b"see https://a.example/x, xhttp://no.example and (www.c.example).\r\n--b\r\nContent-Type: text/html\r\n\r\n" + html.encode() + b"\r\n--b--\r\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.eml").write_bytes(raw)
    (tmp_path / "two.eml").write_bytes(b"no mail at all")
    (tmp_path / "three.txt").write_bytes(raw)
    got = {r["id"].rsplit("/", 1)[1]: r for r in mailfiles.read_eml(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.eml", "two.eml"} and got["two.eml"]["error"] == "not a mail" and got["one.eml"]["reply_to"] == "other@y.example"
    links = [(l["url"], l["anchor_text"], l["found_in"]) for l in got["one.eml"]["urls"]]
    assert links[:2] == [("https://a.example/x", "here", "html"), ("http://www.b.example", "b", "html")]
    assert ("http://www.c.example", None, "text") in links and all(u != "https://a.example/x" for u, _, where in links if where == "text")


@pytest.mark.parametrize("locked", [True, False])
def test_locked_archive(locked):
    data = mailfiles.sample_archive(locked)
    assert mailfiles._locked(data) is locked and not mailfiles._locked(data[:20]) and not mailfiles._locked(b"PK") and not mailfiles._locked(b"")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "x", "v": "1"}\n{"k": "x", "v": "2"}\n\n{"k": "y", "v"\n{"v": "no key"}\n')
    (tmp_path / "b.jsonl").write_text('{"k": "x", "v": "3"}\nnot json\n{"k": "z", "v": "4"}\n')
    rows = records.read_json_lines(spark, str(tmp_path), "k string, v string")
    assert rows.where("corrupt is not null").count() == 2
    assert {tuple(r) for r in records.last_by(rows, "k", "v").collect()} == {("x", "3"), ("z", "4")}
