"""Operators against brute force on small fixtures."""

import glob
import itertools
import math
import random
import re
import tempfile

import numpy as np
from pyspark.sql import functions as F

from lurewatch.operators import campaigns, classifier, graph, metrics, rules
from lurewatch.operators.asof import latest_before
from lurewatch.operators.components import connected_components
from lurewatch.session import CLEANUP, cut_lineage
from lurewatch.sources import mailfiles
from lurewatch.sources.tables import Tables


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in range(n)}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(60, 90)]
    want = {k: v for k, v in components(92, edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want


def test_a_kept_view_leaves_no_shuffle_files(spark):
    folder = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    found = lambda: set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*"))
    before, way = found(), spark.conf.get(CLEANUP)
    rows = spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    assert cut_lineage(rows).agg(F.sum("n")).first()[0] == 1000 and spark.conf.get(CLEANUP) == way
    kept = found() - before
    cut_lineage(rows)
    assert found() - before == kept and rows.count() == 10


def test_similar_texts_equals_all_pairs(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(30)]
    texts = [sorted(set(rng.sample(base, 24) if i % 3 else base[:20] + rng.sample(base, 4))) for i in range(40)]
    texts = list(dict.fromkeys(map(tuple, texts)))
    df = spark.createDataFrame([(f"t{i:02}", list(x)) for i, x in enumerate(texts)], "text_id string, shingles array<string>")
    got = {(r["a"], r["b"]) for r in campaigns.similar_texts(df).collect()}
    want = {(f"t{i:02}", f"t{j:02}") for (i, x), (j, y) in itertools.combinations(enumerate(texts), 2)
            if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    assert got == want and want


def test_clusters_equal_all_pairs_with_a_hot_host(spark):
    """A third of the mails share one host; clusters are the components over every pair within 24 hours."""
    rng = random.Random(7)
    rows = []
    for i in range(120):
        host = "hot.test" if i % 3 == 0 else f"h{rng.randrange(25)}.test"
        words = f"common words here for mail number {rng.randrange(30)} and {rng.randrange(3)} more"
        rows.append((i, i, rng.randrange(0, 10 * 86400), f"a@d{rng.randrange(60)}.test", f"d{i % 60}.test", [host], [], words.split()))
    schema = "message_id bigint, recipient_id bigint, t bigint, sender string, sender_domain string, hosts array<string>, links array<string>, shingles array<string>"
    feats = spark.createDataFrame(rows, schema).withColumn("shingles", F.array_distinct("shingles")).withColumn(
        "text_id", F.sha2(F.array_join(F.array_sort("shingles"), "\n"), 256))

    def linked(x, y):
        a, b = set(x[7]), set(y[7])
        return abs(x[2] - y[2]) <= 86400 and (x[5] == y[5] or x[4] == y[4] or len(a & b) >= 0.8 * len(a | b))

    want = components(120, [(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if linked(x, y)])
    sizes = {r: list(want.values()).count(r) for r in want.values()}
    got = {r["message_id"]: r["campaign_id"] for r in campaigns.clusters(feats).collect()}
    assert got == {m: f"camp-{r}" for m, r in want.items() if sizes[r] > 1}


def test_latest_before(spark):
    rng = random.Random(9)
    left = [(i, rng.randrange(3), rng.randrange(200000)) for i in range(60)]
    right = [(rng.randrange(3), rng.randrange(200000), i) for i in range(40)]
    at = F.timestamp_seconds("s")
    l_df = spark.createDataFrame(left, "i int, k int, s int").select("i", "k", at.alias("ts"))
    r_df = spark.createDataFrame(right, "k int, s int, v int").select("k", at.alias("ts"), "v")
    got = {r["i"]: r["v"] for r in latest_before(l_df, r_df, ["k"], "ts", "v").collect()}
    want = {i: max(((s2, v) for k2, s2, v in right if k2 == k and s2 <= s), default=(0, None))[1] for i, k, s in left}
    assert got == want


def test_metrics(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 1), (0.3, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    pairs = [(p, n) for (p, a), (n, b) in itertools.product(rows, rows) if a == 1 and b == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs)
    assert abs(metrics.roc_auc(df).first()[0] - auc) < 1e-12
    assert tuple(metrics.confusion(df).first()) == (2, 1, 1, 2)


def test_similar_texts_counts_copies_once(spark):
    """Rows of one text, and texts beside empty ones, give each pair once, also of hashed shingles."""
    words = [[f"w{i}" for i in range(20)], [f"w{i}" for i in range(1, 21)], [f"v{i}" for i in range(9)], []]
    rows = [(f"t{i}", x) for i, x in enumerate(words)] * 3
    df = spark.createDataFrame(rows, "text_id string, shingles array<string>")
    got = [tuple(r) for r in campaigns.similar_texts(df).collect()]
    assert got == [("t0", "t1", 19 / 21)]
    hashed = df.withColumn("shingles", F.transform("shingles", lambda s: F.xxhash64(s)))
    assert [tuple(r) for r in campaigns.similar_texts(hashed).collect()] == got


def test_prefixes_come_in_slices_of_one_order(spark):
    """Of every text the first shingles, frequent ones last, also where shingles differ in their last bits alone; no shingle is in two slices."""
    rng = random.Random(3)
    frequent = np.array([7, -(1 << 62), 9, 1 << 61], np.int64)
    texts = [rng.sample(range(-40, 40), 20) + frequent.tolist()[::2] if i % 2 else [rng.randrange(-(1 << 63), 1 << 63) for _ in range(30)] + frequent.tolist() for i in range(40)]
    texts = [list(dict.fromkeys(x)) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, shingles array<long>")
    slices = [campaigns._prefixes(df, frequent, 0.8, part).collect() for part in range(campaigns.SLICES)]
    rank = {w: i + 1 for i, w in enumerate(frequent.tolist())}
    want = set()
    for i, x in enumerate(texts):
        ordered = sorted(x, key=lambda w: (rank.get(w, 0), w % (1 << 64)))
        want |= {(i, len(x), w, at) for at, w in enumerate(ordered[: len(x) - math.ceil(len(x) * 0.8) + 1])}
    assert {tuple(r) for rows in slices for r in rows} == want and sum(map(len, slices)) == len(want)
    words = [{r["w"] for r in rows} for rows in slices]
    assert sum(map(len, words)) == len(set().union(*words)) and max(map(len, slices)) < len(want) / 2


def test_texts_of_pairs_move_slice_by_slice(spark, monkeypatch):
    """Neither all prefixes nor the texts of all pairs are shuffled at once: no table that is written holds more than its slice."""
    rows = [(f"t{i:03}", [f"g{i // 4}w{j}" for j in range(i % 4, 40)]) for i in range(160)]
    df = spark.createDataFrame(rows, "text_id string, shingles array<string>")
    written = []

    def kept(table):
        out = cut_lineage(table)
        written.append((tuple(out.columns), out.count()))
        return out

    monkeypatch.setattr(campaigns, "cut_lineage", kept)
    found = campaigns.similar_texts(df)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    for own in (("a", "b", "x", "y", "shared", "i", "j"), ("a", "b", "similarity")):
        sizes = [n for columns, n in written if columns == own]
        assert len(sizes) == campaigns.SLICES and max(sizes) < sum(sizes) * 0.6


def test_wording_is_counted_in_partitions_that_stay(spark):
    """The exchange has a number of partitions of its own, so that they are not joined until their rows are too many for one task."""
    members = spark.createDataFrame([("c", 1, ["a"])], "campaign_id string, message_id long, shingles array<string>")
    plan = campaigns.traits_wording(members)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[[^]]*\], \d+", plan)


def test_wording_rows_are_made_behind_the_exchange(spark):
    """What is shuffled of a campaign's wording is arrays, not a row for each shingle."""
    rows = [("c", i, [f"s{j}" for j in range(i % 3, 200)]) for i in range(30)]
    members = spark.createDataFrame(rows, "campaign_id string, message_id long, shingles array<string>")
    found = campaigns.traits_wording(members)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, s in enumerate(plan) if "explode(hashed" in s) < next(i for i, s in enumerate(plan) if "RepartitionByExpression" in s)
    k = [sum(j >= i % 3 for i in range(30)) for j in range(200)]
    want = sum((k[j] - 1) / (200 - i % 3) for i in range(30) for j in range(i % 3, 200)) / (30 * 29)
    assert abs(found.first()["mean"] - want) < 1e-9


def test_blast_edges_join_nothing(spark):
    """Ids that are null or occur twice give the rows that joins on the id would give."""
    rows = [(1, "Finance"), (2, "Sales"), (2, "IT"), (None, "IT"), (3, None), (4, "Elsewhere")]
    found = graph.edges(spark.createDataFrame(rows, "employee_id long, department string"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["employee_id"], r["source"], r["target"]): (r["lit"], r["count"]) for r in found.groupBy(*found.columns).count().collect()}
    assert len(got) == 4 * 15 and got[1, "books", "ledger_data"] == (True, 1) and got[1, "crm", "customer_data"] == (False, 1)
    assert got[2, "idp", "mail"] == (True, 2 * 4 * 4) and got[2, "idp", "admin"] == (True, 2 * 4 * 2) and got[2, "hr", "payroll_data"] == (False, 8)
    assert {got[i, "idp", "mail"] for i in (3, 4)} == {(False, 1)}


def test_mails_are_parsed_in_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    mail = b"From: a@b.test\r\nSubject: x\r\n\r\nbody"
    parsed = mailfiles.parse(spark.createDataFrame([("1", mail), ("2", b"")], "id string, content binary"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert {(r["id"], r["sender"], r["error"]) for r in parsed.collect()} == {("1", "a@b.test", None), ("2", None, "not a mail")}


def test_kept_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    kept = cut_lineage(spark.range(40).withColumn("v", F.lit("x")).mapInPandas(run, "id long, v string"))
    assert kept.agg(F.sum("id")).first()[0] == 780 and kept.columns == ["id", "v"] and seen.value == 40


def test_mails_are_dealt_out_before_the_rules(spark, tmp_path):
    """A table of one row group is no single task."""
    spark.range(500).selectExpr("id as doc_id", "'some text' as text", "'en' as lang", "'s' as source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(9).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    sizes = Tables(spark, str(tmp_path)).dealt_messages.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 8 and sum(r["count"] for r in sizes) == 500 and max(r["count"] for r in sizes) < 250


def test_employees_are_dealt_out(spark):
    """The names of a table of one row group are no single task; ids and names that are null or come twice change nothing."""
    people = [(i, f"Ada Vale{i}", "Clerk") for i in range(400)] + [(7, "Ada Vale7", "Clerk"), (900, "Ada Vale7", "Boss"), (None, None, None)]
    staff = spark.createDataFrame(people, "employee_id long, name string, title string").coalesce(1)
    mails = [(1, "Ada Vale7", "x@far.test"), (2, "Vale399 Ada", "x@far.test"), (3, "Someone Else", "x@far.test"), (4, None, "x@far.test")]
    found = rules.colleague_hits(spark.createDataFrame(mails, "message_id long, sender_name string, sender string"), staff)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 8, true" in plan and "strategy=merge" in plan
    assert sorted((r["message_id"], "Ada Vale7" in r["signal"]["evidence"]) for r in found.collect()) == [(1, True), (2, False)]


def test_training_reads_its_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    words = ["offer money prize", "meeting notes report"]
    rows = [(i, "s", f"text {i} of class {words[i % 2]}", i % 2) for i in range(40)]
    kinds = "key long, source string, text string, label int"
    texts = spark.createDataFrame(rows, kinds)
    model = classifier.train(texts.mapInPandas(run, kinds), bits=6)
    assert seen.value == 40
    scored = {r["key"]: r["score"] for r in classifier.predict(model, texts).collect()}
    assert all((scored[i] > 0.5) == (i % 2 == 1) for i in range(40))


def test_character_grams(spark):
    found = classifier.with_grams(spark.createDataFrame([("ab  cdef x",), (None,)], "text string")).collect()
    want = [w[i : i + n] for w in (" ab ", "  ", " cdef ", " x ") for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    assert found[0]["chars"] == want and found[1]["chars"] is None
