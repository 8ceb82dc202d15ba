"""The queries against plain Python over whole tables."""

import base64
import collections
import hashlib
import html
import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lurewatch.llm import blocks, catalog, gru, language, language_model, mixing, pieces, quality, secrets, sketches, vectors, warc
from lurewatch.llm.common import stored, table, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark, folder):
    return {r["doc_id"]: r for r in table(spark, folder, "documents").collect()}


def run(spark, folder, name, key="doc_id"):
    return {r[key]: r for r in catalog.queries()[name](spark, folder).collect()}


def components(keys, links):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def shingles(text, words):
    own = WORD.findall(lowered(text))
    return frozenset([tuple(own)] if 0 < len(own) < words else zip(*(own[k:] for k in range(words))))


def similar(docs, words):
    sets = {i: shingles(r["text"], words) for i, r in docs.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, components(sets, links)


def test_near_duplicates(spark, folder, docs):
    sets, component = similar(docs, 2)
    got = run(spark, folder, "op10_setsketch")
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (len(sets[i]), component[i], component[i] == i) for i in docs}


def test_mail_merge(spark):
    """A large group of near copies: the links grow with the copies, not with their pairs."""
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:50] + [f"name{i}"] + base[51:]) for i in range(600)] + ["entirely different words here"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sketches.near_duplicates(docs, words=2).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 600} == {0} and {r["component_id"] for r in got if r["doc_id"] >= 600} == {600}


def test_null_and_repeated_ids(spark):
    """A text without an id, and one whose id another text has, still meet their near copies."""
    base = [f"w{k}" for k in range(200)]
    near = lambda k: " ".join(base[:k] + ["changed"] + base[k + 1 :])
    other = " ".join(f"v{k}" for k in range(120))
    rows = [(None, near(20)), (None, near(20)), (5, near(70)), (5, other), (9, other + " end"), (9, near(130)), (12, "words of its own")]
    got = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got.collect())
    assert found == sorted([("None", 199, 5), ("None", 199, 5), ("5", 199, 5), ("5", 119, 5), ("9", 120, 5), ("9", 199, 5), ("12", 3, 12)])


def test_areas_of_buckets(spark, monkeypatch):
    """Chunks over merged buckets and over single ones link the same."""
    draw = np.random.default_rng(6)
    base = draw.integers(0, 10_000, 150)
    rows = []
    for i in range(160):
        own = base.copy()
        own[draw.choice(150, 6 + i % 9, replace=False)] = draw.integers(10_000, 99_999, 6 + i % 9)
        rows.append((i, " ".join(map(str, own))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = similar({i: {"text": t} for i, t in rows}, 2)[1]
    monkeypatch.setattr(sketches, "CHUNK", 16)
    plain = lambda: {r["doc_id"]: r["component_id"] for r in sketches.near_duplicates(docs, words=2).collect()}
    assert plain() == wanted
    monkeypatch.setattr(sketches, "_areas", lambda left: left)
    assert plain() == wanted


@pytest.mark.parametrize("before, after", [
    ("https://" + "u" * 70 + ":", "@host.example/x"), ("redis://:", "@cache:6379"), ("password:\t", " end"), ("password:\n", "\nend"), ("pwd: ", "."),
    ("mypassword: ", ", and"), ("db_secret = ", ""), ("Your password is ", "!"), ("token => ", ""), ("PASSWD := '", "'"), ('"client_secret": "', '"')])
def test_contexts_of_secrets(before, after):
    """A planted value is found whole in each form, and nothing of it stays in the cleaned text."""
    ranks, value = secrets.word_ranks(), "Xk9,fQ2;m7TzPq#w"
    text = f"Some words. {before}{value}{after}"
    spans = secrets.find(text, ranks)
    assert any(text[s.secret_start : s.end] == value for s in spans) and secrets.hidden(text, spans) == f"Some words. {before}[SECRET]{after}"


def test_contexts_leave_prose_alone():
    ranks = secrets.word_ranks()
    for text in ("Enter your password:\n\nThanks and regards", "shopping: everything we need today", "The secret: nothing special", "see https://a.example:8080/path@b"):
        assert [s for s in secrets.find(text, ranks) if s.kind == "guess"] == []


def test_registers():
    draw = np.random.default_rng(3)
    whole = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = whole[:2000], whole[1000:]
    own = sketches.registers(a), sketches.registers(b)
    assert (sketches.merged(*own) == sketches.registers(whole)).all()
    found = sketches.likely_similarity(own[0][None], own[1][None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(found - 1 / 3) < 5 * math.sqrt(2 / 9 / len(own[0]))


def test_embeddings(spark, folder):
    rows = table(spark, folder, "embeddings").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    ids = [r["vec_id"] for r in rows]
    component = components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close))])
    got = run(spark, folder, "op2_int8_tiles", "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (int(n), component[i]) for i, n in zip(ids, close.sum(axis=1))}


def test_bounds_hold():
    draw = np.random.default_rng(4)
    x = vectors.units(draw.normal(size=(300, 48)) * draw.exponential(size=(300, 48)) ** 3)
    rows, columns = vectors.possible(vectors.quantised(x), vectors.quantised(x), 0.3)
    found = set(zip(rows.tolist(), columns.tolist()))
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.3))} <= found and len(found) < 90_000


def test_language(spark, folder, docs):
    got = run(spark, folder, "op6_word_backoff")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(docs[i]["lang"], r["lang_pred"]) for i, r in got.items() if r["held_out"] and docs[i]["lang"]]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)


def test_backoff_order():
    model = language.Model(["a", "b"], {"abc": np.array([-1.0, -2.0])}, {"xy": np.array([-3.0, -1.0]), "x": np.array([-5.0, -5.0]), "y": np.array([-6.0, -6.0])}, np.array([-9.0, -9.0]))
    scorer, step = language.Scorer(model), language.BACKOFF
    assert scorer.word("abc").tolist() == [-1.0, -2.0]
    assert scorer.backed_off("xyx") == pytest.approx([-3 - 5 + 5 * step, -1 - 5 + 5 * step])  # xy (order 2 of 4), then x
    assert scorer.text("abc")[0] == "a" and scorer.text("12 !") == ("und", 0.0)


def test_language_model(spark, folder, docs):
    own = {i: WORD.findall(lowered(r["text"])) + [None] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = collections.Counter(w for i, ws in own.items() if not held[i] for w in ws)
    total, norm = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    got = run(spark, folder, "op3_gru")
    for i, ws in own.items():
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10(counts[w] + 1) - norm for w in ws))
    new = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def test_model_learns_from_all_documents(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("own"), F.repeat(F.lit("some word "), 5000)).alias("text"))
    seen = []
    monkeypatch.setattr(language_model, "_round", lambda shards, *_: seen.append(shards.select(F.sum(F.size(words_of(F.col("text"))) + 1)).first()[0]))
    assert language_model.learn(docs).train_tokens == sum(seen) == 400 * 10_002


def test_windows_hold_all_tokens():
    docs = [np.full(n, i, np.int32) for i, n in enumerate([1, 5, 40, 3, 700] * 9)]
    seen = collections.Counter(x for _, targets, _, _ in gru.windows(docs, 0) for x in targets.ravel().tolist() if x >= 0)
    assert seen == {i: len(d) for i, d in enumerate(docs)}


def test_probabilities_sum_to_one():
    model = gru.start(np.array([40.0, 20, 10, 5, 5, 2, 1]), hidden=4, classes=3)
    draw = np.random.default_rng(0)
    for name in ("to_class", "to_token"):
        getattr(model, name)[...] = draw.normal(size=getattr(model, name).shape)
    states = draw.normal(size=(1, 4)).astype(np.float32)
    assert np.exp(gru.log_probabilities(model, np.repeat(states, 7, axis=0), np.arange(7))).sum() == pytest.approx(1, abs=1e-5)


def test_gradients():
    model = gru.start(np.array([4.0, 3, 2, 1]), hidden=3, classes=2)
    draw = np.random.default_rng(1)
    grads = {n: np.zeros_like(getattr(model, n)) for n in gru._TRAINED}
    for name in ("to_class", "to_token"):
        getattr(model, name)[...] = draw.normal(size=getattr(model, name).shape)
    states, targets = draw.normal(size=(6, 3)).astype(np.float32), np.array([0, 1, 2, 3, 1, 0])
    back, loss = gru._output_gradients(model, states, targets, grads)
    moved = states.copy()
    moved[2, 1] += 1e-2
    assert (-gru.log_probabilities(model, moved, targets).mean() - loss) / 1e-2 == pytest.approx(back[2, 1], abs=2e-3)


def test_recurrent_gradients():
    """Each trained array's gradient against a difference quotient, over lanes that start afresh and end within the window."""
    model = gru.start(np.array([9.0, 8, 7, 6, 5]), hidden=3, classes=2)
    draw = np.random.default_rng(4)
    for name in gru._TRAINED:
        getattr(model, name)[...] += draw.normal(0, 0.5, getattr(model, name).shape)
    reads, targets, fresh = draw.integers(0, 5, (6, 4)), draw.integers(0, 5, (6, 4)), draw.random((6, 4)) < 0.2
    targets[4:, 1] = -1
    state, grads = draw.normal(size=(4, 3)).astype(np.float32), {n: np.zeros_like(getattr(model, n)) for n in gru._TRAINED}
    gru.window_gradients(model, reads, targets, fresh, state, grads)
    loss = lambda: gru.window_gradients(model, reads, targets, fresh, state, {n: np.zeros_like(v) for n, v in grads.items()})[1]
    for name in gru._TRAINED:
        own, step = getattr(model, name), 5e-3
        for at in list(np.ndindex(own.shape))[:: max(1, own.size // 12)]:
            kept = own[at]
            own[at] = kept + step
            above = loss()
            own[at] = kept - step
            below = loss()
            own[at] = kept
            assert (above - below) / (2 * step) == pytest.approx(grads[name][at], abs=1e-3), (name, at)


def test_states_of_a_step_equal_plain_ones():
    """Bit by bit, also where exponentials overflow."""
    draw, h = np.random.default_rng(8), 5
    for size in (1, 200):
        inputs, recurrent = (draw.normal(0, size, (n, 3 * h)).astype(np.float32) for n in (9, h))
        reads, s = draw.integers(0, 9, 60), draw.uniform(-1, 1, (60, h)).astype(np.float32)
        gate, own = inputs[reads], s @ recurrent
        with np.errstate(over="ignore"):
            both = 1 / (1 + np.exp(-(gate[:, : 2 * h] + own[:, : 2 * h])))
            got = gru._step(gru._by_gate(inputs).take(reads, axis=1), s, gru._by_gate(recurrent))
        new = np.tanh(gate[:, 2 * h :] + both[:, h:] * own[:, 2 * h :])
        assert (got == new + both[:, :h] * (s - new)).all()


def test_state_goes_on_over_windows(monkeypatch):
    model = gru.start(np.array([9.0, 8, 7, 6, 5]), hidden=4, classes=2)
    draw = np.random.default_rng(2)
    for name in ("to_class", "to_token", "inputs"):
        getattr(model, name)[...] = draw.normal(size=getattr(model, name).shape)
    docs = [draw.integers(0, 5, n).astype(np.int32) for n in (3, 90, 1, 200)]
    whole = gru.score(model, docs, 0)
    monkeypatch.setattr(gru, "WINDOW", 7)
    assert gru.score(model, docs, 0) == pytest.approx(whole, rel=1e-5)
    assert [gru.score(model, [d], 0)[0] for d in docs] == pytest.approx(whole, rel=1e-5)


def test_a_long_document_beside_short_ones():
    """Memory follows the tokens, not the longest document times the lanes."""
    model = gru.start(np.array([9.0, 8, 7]), hidden=2, classes=2)
    docs = [np.zeros(100_000, np.int32)] + [np.ones(2, np.int32)] * 63
    tracemalloc.start()
    gru.score(model, docs, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_stretches_join(monkeypatch):
    model = gru.start(np.array([9.0, 8, 7, 6, 5]), hidden=4, classes=2)
    draw = np.random.default_rng(3)
    for name in ("to_class", "to_token", "inputs"):
        getattr(model, name)[...] = draw.normal(size=getattr(model, name).shape)
    docs = [draw.integers(0, 5, n).astype(np.int32) for n in (300, 90, 1, 200)]
    whole = gru.score(model, docs, 0)
    monkeypatch.setattr(gru, "STEPS", gru.WINDOW)
    assert gru.score(model, docs, 0) == pytest.approx(whole, rel=1e-5)
    assert [gru.score(model, [d], 0)[0] for d in docs] == pytest.approx(whole, rel=1e-5)


def test_buckets_agree(spark):
    words = [b"a", b"ab", b"abc", "über".encode(), "x€".encode()]
    got = spark.createDataFrame([(w,) for w in words], "word binary").selectExpr(f"crc32(substring(word, -2, 2)) % {language_model.BUCKETS} AS b").collect()
    assert [r["b"] for r in got] == [language_model.bucket_of(w) for w in words]


def test_secrets(spark, folder, docs):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = run(spark, folder, "op4_guess_cost")
    for i, r in docs.items():
        text = r["text"] or ""
        found = [("assign", m) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in sorted(found, key=lambda x: (x[1].start(), ("assign", "access", "hex").index(x[0]))))
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[i]["spans"].split(","))


def test_guess_costs():
    ranks = {"summer": 2.0, "dragon": 1.0}
    cost = lambda v: secrets.log_guesses(v, ranks)
    assert cost("dragon") == pytest.approx(1.3) and cost("x7Kq9ZwT") > 9 > cost("summer2024")
    assert cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("abcabcabcabc") < 6 and cost("2024-01-31") < 7
    assert cost("") == 0


def test_quality(spark, folder, docs):
    got = run(spark, folder, "op5_weak_supervision")
    for i, r in docs.items():
        text = r["text"] or ""
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got[i]["base_failed"] and got[i]["kept"])


def test_expectation_maximisation():
    """Rules of known accuracy: the estimates come near, and the posterior beats every single rule."""
    draw, k = np.random.default_rng(6), len(quality.RULES)
    good, right = draw.random(20_000) < 0.7, np.linspace(0.65, 0.95, k)
    votes = np.where(draw.random((20_000, k)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None]) * (draw.random((20_000, k)) < 0.7)
    model = quality.fit(list(collections.Counter(map(tuple, votes.tolist())).items()))
    assert abs(model.good - 0.7) < 0.03 and np.abs(np.array(model.on_good) - right).max() < 0.04
    verdict = np.array([model.posterior(v) >= 0.5 for v in votes.tolist()])
    assert (verdict == good).mean() > 0.93


def test_quality_against_labels(spark, folder):
    got = run(spark, folder, "op5_weak_supervision")
    pairs = [(r["quality"], got[r["doc_id"]]) for r in table(spark, folder, "labels").collect() if r["doc_id"] in got]
    clean = [r["kept"] for q, r in pairs if q == 1 and not r["base_failed"]]
    assert sum(clean) >= 0.99 * len(clean)
    poor = [r["kept"] for q, r in pairs if q == 0]
    assert sum(poor) <= 0.2 * len(poor)


def test_extraction(spark, folder):
    got = run(spark, folder, "op1_crf_extraction", "page_id")
    for r in table(spark, folder, "pages").collect():
        article = (r["html"] or "").partition("<article>")[2].partition("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        want = " ".join(" ".join(html.unescape(x).split()) for x in parts if x.strip())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


@pytest.mark.parametrize("skipped", ["<svg/>", '<math display="block" />', "<SVG viewBox='0 0'/>", "<svg>a<svg>b</svg>c</svg>", "<svg>a<svg x='1'/>b</svg>",
                                     "<svg width=1/>a</svg>", "<math>a<!-- </math> -->b</math>"])
def test_foreign_elements(skipped):
    assert " ".join(b.text for b in blocks.blocks(f"<p>one {skipped} two<p>three")) == "one two three"


def test_warc(spark, folder):
    got = run(spark, folder, "op7_warc_revisits", "page_id")
    rows = table(spark, folder, "pages").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    for r in rows:
        body, own = (r["html"] or "").encode(), first[r["html"] or ""]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own == r["page_id"] else "revisit", None if own == r["page_id"] else own)
        assert tuple(got[r["page_id"]][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_warc_pushdown(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.example/{i}", "<p>" + "same " * 3000 if i % 3 else f"own {i}") for i in range(40)], "page_id long, url string, html string")
    warc.with_revisits(pages).write.format("warc").mode("append").save(str(tmp_path / "w"))
    read = spark.read.format("warc").option("payload", "false").load(str(tmp_path / "w"))
    got = read.where("record_type = 'revisit' AND target_uri LIKE 'http://a%' AND content_length < 1000000")
    assert {r["record_id"] for r in got.collect()} == {f"<urn:page:{i}>" for i in range(2, 40, 2) if i % 3}
    assert read.where("payload IS NOT NULL").isEmpty() and read.count() == 40


def test_plain_and_foreign_archives(spark, tmp_path):
    import gzip

    record = warc.record("<urn:x:1>", "response", "http://x.example/", None, base64.b32encode(hashlib.sha1(b"body").digest()).decode(), 4, b"body")
    (tmp_path / "a.warc").write_bytes(record * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) * 2)
    warc.register(spark)
    got = spark.read.format("warc").option("verify", "true").load(str(tmp_path)).collect()
    assert [bytes(r["payload"]) for r in got] == [b"body"] * 5 and {r["content_length"] for r in got} == {len(record.split(b"\r\n\r\n", 1)[1]) - 4}


def test_mixing(spark, folder, docs):
    got = run(spark, folder, "op8_pfair")
    sizes = collections.Counter(r["source"] for r in docs.values())
    quota = mixing.shares({s: n**0.5 for s, n in sizes.items()}, mixing.PERIOD)
    blocks = collections.defaultdict(set)
    for r in got.values():
        blocks[r["source"], r["block"]].add(r["slot"])
    assert all(len(s) == 1 for s in blocks.values()) and len(set().union(*blocks.values())) == len(blocks)
    assert collections.Counter((r["slot"], r["place"]) for r in got.values()).most_common(1)[0][1] == 1
    at = {next(iter(s)): k[0] for k, s in blocks.items()}
    horizon = max((r["slot"] for r in got.values() if r["in_mixture"]), default=-1) + 1
    had = collections.Counter()
    for slot in range(horizon):
        had[at[slot]] += 1
        assert all(abs(had[s] - (slot + 1) * quota[s] / sum(quota.values())) < 1 for s in sizes)


@pytest.mark.parametrize("quota", [[1], [1, 1], [5, 3, 1, 1], [97, 1, 1, 1], [7] * 11, [400, 33, 21, 8, 1]])
def test_schedule(quota):
    slots, period = mixing.schedule(quota), sum(quota)
    assert sorted(x for own in slots for x in own) == list(range(period))
    for q, own in zip(quota, slots):
        assert all(k * period // q <= x < -(-(k + 1) * period // q) for k, x in enumerate(own))


def test_pieces(spark, folder, docs):
    words = pieces.vocabulary()
    got = run(spark, folder, "op9_sampled_pieces")
    for i, r in docs.items():
        assert got[i]["lossless"] and pieces.decode(got[i]["pieces"], words.spelled) == r["text"] and got[i]["n_pieces"] == len(got[i]["pieces"])
    again = run(spark, folder, "op9_sampled_pieces")
    assert all(got[i]["pieces"] == again[i]["pieces"] for i in docs)


def test_piece_distribution():
    names, weights = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, np.array([0.3, 0.2, 0.1, 0.15, 0.25])
    words = pieces.trie(names, weights, [0] * 256, [n.encode() for n in names])

    def ways(text):
        if not text:
            yield (), 1.0
        for name, i in names.items():
            if text.startswith(name):
                for rest, p in ways(text[len(name):]):
                    yield (i, *rest), weights[i] * p

    want, n = dict(ways("ababa")), 30_000
    ids, sizes = pieces.sample(words, list(range(n)), ["ababa"] * n)
    stops = np.cumsum(sizes)
    seen = collections.Counter(tuple(ids[b - k : b].tolist()) for b, k in zip(stops, sizes))
    assert set(seen) <= set(want) and max(abs(seen[w] / n - p / sum(want.values())) for w, p in want.items()) < 0.01


def test_draws_meet_edges_of_their_own_state():
    """The edge of a draw is the first of its state whose bound is above it, and never one of the next state, however near to 1 the draw."""
    kept = pieces.Kept(pieces.vocabulary())
    ends = kept.ends([f" part{i} banana{i * 7919}" for i in range(9000)])
    bounds, draw = kept.bounds[: kept.edges], np.random.default_rng(1)
    target = np.ceil(bounds[1:]).astype(np.int64) - 1  # of each edge its state
    states = np.unique(np.concatenate([ends, target]))
    for draws in (draw.random(len(states)), np.zeros(len(states)), np.full(len(states), 1 - 2.0**-53)):
        found = kept.edge(states, draws)
        assert (target[found - 1] == states).all()
        plain = np.minimum(np.searchsorted(bounds, states + draws, side="right"), kept.tops[states])
        assert (found == plain).all()
    assert (np.searchsorted(bounds, states + (1 - 2.0**-53), side="right") > kept.tops[states]).any()  # a search over all edges leaves the state


def test_pieces_filter_a_part_once(monkeypatch):
    words, made, own = pieces.vocabulary(), [], pieces.Lattices
    assert (words.entries(words.keys) == np.arange(len(words.keys))).all() and (words.entries(words.keys + (1 << 50)) == -1).all()
    texts = [f"this is a text {k % 7} of some words\t\u4e16{'ab' * (k % 5)}" for k in range(60)]
    plain = [pieces.sample(words, [k], [text])[0].tolist() for k, text in enumerate(texts)]
    monkeypatch.setattr(pieces, "Lattices", lambda words, parts, first: made.extend(parts) or own(words, parts, first))
    for room in (10**6, 40):  # the second has no room for all parts
        monkeypatch.setattr(pieces, "KEPT", room)
        made.clear()
        kept = pieces.Kept(words)
        assert [pieces.sample(words, [k], [text], kept=kept)[0].tolist() for k, text in enumerate(texts)] == plain
        assert (len(made) == len(set(made))) == (room > 40)


def test_pipeline(spark, folder, docs):
    """Stages 1 to 3 by brute force; the last stage decodes to what they leave."""
    words = pieces.vocabulary()
    left = {i: r for i, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    _, component = similar(left, sketches.SHINGLE_WORDS)
    ranks = secrets.word_ranks()
    want = {i: secrets.hidden(r["text"], secrets.find(r["text"], ranks)) for i, r in left.items() if component[i] == i}
    got = {r["doc_id"]: pieces.decode(r["pieces"], words.spelled) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want


def test_pipeline_keeps_the_mixture(spark, folder, monkeypatch):
    """Read by mix_order, the pipeline's result is the schedule of what the third stage leaves: sources keep their shares."""
    monkeypatch.setattr(mixing, "BLOCK", 1)
    monkeypatch.setattr(mixing.scheduled, "__defaults__", tuple(1 if x == 16 else x for x in mixing.scheduled.__defaults__))
    odd = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in odd}
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, folder), "before-mixing")
    slots = {r["doc_id"]: r for r in mixing.scheduled(docs).collect()}
    want = [i for i, _ in sorted(slots.items(), key=lambda x: (x[1]["slot"], x[1]["place"]))]
    try:
        for k, v in odd.items():  # many files, whose parts are read in another order
            spark.conf.set(k, v)
        rows = corpus_pipeline.run(spark, folder).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = [r["doc_id"] for r in sorted(rows, key=lambda r: r["mix_order"])]
    assert got == want
    sizes = collections.Counter(r["source"] for r in slots.values())
    quota, had = mixing.shares({s: n**0.5 for s, n in sizes.items()}, mixing.PERIOD), collections.Counter()
    assert any(r["in_mixture"] for r in slots.values())
    for n, i in enumerate(got, 1):
        if not slots[i]["in_mixture"]:
            break
        had[slots[i]["source"]] += 1
        assert all(abs(had[s] - n * quota[s] / sum(quota.values())) < 1 for s in sizes)
