"""Queries that lost rows, failed or kept too much, on rows of their own."""

import datetime as dt
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lurewatch.operators import campaigns, casebook, classifier
from lurewatch.plans.response import expanded_recipients
from lurewatch.session import cut_lineage, shared_folder
from lurewatch.sources import mailfiles
from lurewatch.sources.tables import Tables
from lurewatch.streaming import live

WORDS = "please read the new figures of this quarter and send them back to the whole team before noon on monday".split()


def folder_of(spark, path, documents, customers=30, files=1):
    """Documents and customers as tables in a folder; a table of several files is a folder of its own."""
    rows = [(i, text, "en", "web", len(text)) for i, text in documents]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.parquet(f"{path}/documents.parquet")
    people = [(i, i % 25, "BUILDING") for i in range(customers)]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    return str(path)


def texts(n):
    return [(i, " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 30))) for i in range(n)]


def test_stream_reads_a_table_of_several_files(spark, tmp_path):
    """A table may be a folder of files, of which none bears the table's name."""
    folder, queries = folder_of(spark, tmp_path, texts(48), files=3), entry.queries()
    found = {tuple(r) for r in queries["st_score_on_delivery"](spark, folder).collect()}
    assert found == {(r["message_id"], r["risk"]) for r in queries["agg_risk_fusion"](spark, folder).collect()} and len(found) == 48


def test_stream_reads_a_table_of_one_file(spark, tmp_path):
    folder = folder_of(spark, tmp_path / "whole", texts(24))
    file = next((tmp_path / "whole" / "documents.parquet").glob("*.parquet"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "documents.parquet").write_bytes(file.read_bytes())
    (tmp_path / "one" / "customer.parquet").symlink_to(f"{folder}/customer.parquet")
    assert live.to_table(Tables(spark, str(tmp_path / "one")).stream("documents"), "copied").count() == 24


def drawn_cases(spark, seed, evidence=400, closings=60):
    """Evidence (id, ts, employee, campaign) and containments of campaigns and of people, few of each so that much closes and opens again."""
    draw = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=draw.randrange(10**6))
    rows = [(i, at(), draw.randrange(12), draw.choice([None, None, "camp-1", "camp-2", "camp-3", "camp-4"])) for i in range(evidence)]
    campaigns = [(f"camp-{draw.randrange(1, 5)}", at()) for _ in range(closings)]
    people = [(draw.randrange(12), at()) for _ in range(closings)]
    frames = (spark.createDataFrame(rows, "evidence_id long, ts timestamp, employee_id long, campaign_id string"),
              spark.createDataFrame(campaigns, "campaign_id string, at timestamp"), spark.createDataFrame(people, "employee_id long, at timestamp"))
    return rows, campaigns, people, frames


def folded(rows, campaigns, people, follow):
    """One happening after the other; with ``follow`` evidence whose campaign has no open incident goes to its employee's newest."""
    happenings = [(ts, 1, i, who, camp) for i, ts, who, camp in rows]
    happenings += [(at, 0, -1, None, camp) for camp, at in campaigns] + [(at, 0, -1, who, None) for who, at in people]
    book, roots = {}, {}
    for _, rank, i, who, camp in sorted(happenings, key=lambda h: h[:3]):
        live_ones = [r for r, c in book.items() if c["open"]]
        if rank == 0:
            for r in live_ones:
                if (camp is not None and book[r]["camp"] == camp) or who in book[r]["people"]:
                    book[r]["open"] = False
            continue
        root = next((r for r in live_ones if camp is not None and book[r]["camp"] == camp), None)
        if root is None and (follow or camp is None):
            root = next((r for r in reversed(live_ones) if who in book[r]["people"]), None)
        case = book.setdefault(i if root is None else root, {"open": True, "camp": None, "people": set()})
        case["camp"] = case["camp"] or camp
        case["people"].add(who)
        roots[i] = i if root is None else root
    return roots, {r: (c["camp"], "open" if c["open"] else "contained") for r, c in book.items()}


@pytest.mark.parametrize("follow", [True, False])
def test_routing_is_the_fold(spark, follow):
    """Evidence of a campaign without an open incident follows its employee, and the campaign is filled in where none was."""
    rows, campaigns, people, frames = drawn_cases(spark, 3)
    roots, book = folded(rows, campaigns, people, follow)
    routed = casebook.route(*frames, **({"follow": True} if follow else {}))
    assert {r["evidence_id"]: r["root"] for r in routed.collect()} == roots
    found = casebook.book(frames[0].withColumn("severity", F.lit(2)), routed, *frames[1:]).collect()
    assert {r["root"]: (r["campaign_id"], r["status"]) for r in found} == book


def test_routing_keeps_few_tables(spark):
    """What stays on the disk must not grow with the containments that follow one another."""
    views = lambda: len(os.listdir(f"{shared_folder(spark)}/views"))
    *_, frames = drawn_cases(spark, 4)
    cut_lineage(spark.range(1))
    before = views()
    casebook.route(*frames).collect()
    assert views() - before <= 4


def test_every_matching_pair_is_scored(spark):
    """All pairs by host, by sender domain or by wording alone, within the window; not one for each mail and key."""
    draw, rows = random.Random(5), []
    for i in range(60):
        words = list(range(20 * (i % 4), 20 * (i % 4) + 20))
        for _ in range(i % 3):
            words[draw.randrange(20)] = 1000 + i
        shingles = sorted(set(words)) if i % 15 else []
        text = "-".join(map(str, shingles)) or None
        rows.append((i, draw.randrange(200_000), draw.choice(["", "", "a.example", "b.example"]), draw.sample(["h1", "h2", "h3", "h4", "h5"], draw.choice([0, 0, 1, 2])), text, shingles))
    feats = spark.createDataFrame(rows, "message_id long, t long, sender_domain string, hosts array<string>, text_id string, shingles array<long>")
    want = {}
    for a in rows:
        for b in rows:
            near = len(set(a[5]) & set(b[5])) / max(1, len(set(a[5]) | set(b[5])))
            score = 2 * bool(set(a[3]) & set(b[3])) + 2 * (a[2] == b[2] != "") + (2 if near >= 0.8 else 1 if near >= 0.5 else 0)
            if (a[1], a[0]) < (b[1], b[0]) and b[1] - a[1] <= 86400 and score >= 2:
                want[a[0], b[0]] = score
    score, _ = campaigns.pair_score("x", "y", known=(F.col("host"), F.col("domain"), F.col("similarity")))
    found = [tuple(r) for r in campaigns.matching_pairs(feats).select("x.message_id", "y.message_id", score).collect()]
    assert {(a, b): s for a, b, s in found} == want and len(found) == len(want)
    assert any(s == 2 and not set(rows[a][3]) & set(rows[b][3]) and "" in (rows[a][2], rows[b][2]) for a, b, s in found)  # by wording alone


def test_recipients_of_a_list(spark):
    """Every mail to the list reaches all of its members once, others their first address; no shuffle tells the pairs apart."""
    mails = [(1, 21, ["a@x.example"]), (1, 21, ["a@x.example"]), (2, 3, ["user2@x.example"]), (3, 21, []), (4, 5, ["nobody@x.example"]), (5, 1, [None]), (6, 1, ["user1@x.example"]), (6, 1, ["user2@x.example"])]
    people = [(i, f"user{i}@x.example", "Management" if i % 3 == 0 else "Sales") for i in range(40)] + [(0, "user0@x.example", "Management")]
    messages = spark.createDataFrame(mails, "message_id long, kind int, recipients array<string>")
    employees = spark.createDataFrame(people, "employee_id long, email string, department string")
    found = expanded_recipients(messages, employees)
    rows = [tuple(r) for r in found.collect()]
    members = range(0, 40, 3)
    assert sorted(rows) == sorted([(i, m) for i in (1, 3) for m in members] + [(2, 2), (6, 1), (6, 2)])


def test_mail_files_are_written_alone(spark, tmp_path):
    """A file for each mail, and beside it no checksum, which costs as much as the file."""
    files = spark.createDataFrame([(str(i), f"Subject: s{i}\r\n\r\nbody {i}".encode()) for i in range(30)], "id string, content binary")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    mailfiles.write_eml(files, str(tmp_path / "mail"))
    written = [p for p in (tmp_path / "mail").rglob("*") if p.is_file() and p.name != "_SUCCESS"]
    assert len(written) == 30 and {p.suffix for p in written} == {".txt"}
    with mailfiles.many_files(spark):
        read = mailfiles.read_eml(spark, str(tmp_path / "mail"), "*.txt").select("id", "subject", "error").collect()
    assert {(r["id"].split("id=")[1].split("/")[0], r["subject"], r["error"]) for r in read} == {(str(i), f"s{i}", None) for i in range(30)}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_counted_terms_lie_in_small_groups(spark):
    """A reader holds a row group unpacked, up to 4,096 rows; a text's counts are large."""
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("key"), F.lit("web").alias("source"), (F.col("id") % 2).alias("label"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(120)), lambda i: F.substring(F.md5(F.concat(F.col("id").cast("string"), i.cast("string"))), 1, 9))).alias("text"))
    _, counted = classifier.term_counts(texts, bits=14)
    rows = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in counted.inputFiles()]
    assert sum(m.num_rows for m in rows) == 3000 and max(m.row_group(i).num_rows for m in rows for i in range(m.num_row_groups)) < 1500
