"""Every operator over awkward and empty tables."""

import hashlib

import pytest

import corpus_pipeline
from lurewatch.llm import extraction, language, language_model, mixing, pieces, quality, secrets, sketches, vectors, warc
from tests.llm import odd

OVER = {
    "documents": {"language": language.digest, "model": language_model.digest, "mixing": mixing.digest, "pieces": pieces.digest,
                  "quality": quality.digest, "secrets": secrets.digest, "sketches": sketches.digest},
    "vectors": {"vectors": vectors.digest},
    "pages": {"extraction": extraction.digest, "warc": warc.digest},
}
CASES = [(table, name) for table, own in OVER.items() for name in own]


@pytest.mark.parametrize("table, name", CASES)
def test_empty_table(spark, table, name):
    whole = getattr(odd, table)(spark)
    assert OVER[table][name](whole.limit(0)).collect() == []


@pytest.mark.parametrize("table, name", CASES)
def test_a_row_for_each_row(spark, table, name):
    whole = getattr(odd, table)(spark)
    key = whole.columns[0]
    got = sorted(str(r[key]) for r in OVER[table][name](whole).collect())
    assert got == sorted(str(r[key]) for r in whole.select(key).collect())


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_language(spark):
    got = rows(language.digest(odd.documents(spark)))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (5, 6, 7, 8))
    assert got[11]["lang_pred"] in ("de", "en") and 0 <= got[11]["score"] <= 1


def test_model(spark):
    got = rows(language_model.digest(odd.documents(spark)))
    assert got[5]["n_tokens"] == got[6]["n_tokens"] == got[7]["n_tokens"] == 1 and got[5]["score"] == pytest.approx(got[6]["score"])
    assert got[12]["n_tokens"] == 30_002 and got[1]["score"] == pytest.approx(got[2]["score"])


def test_sketches(spark):
    got = rows(sketches.digest(odd.documents(spark)))
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)] == [1, 1, 1, 4, 5, 6, 7, 9, 10]
    assert [got[i]["n_shingles"] for i in (5, 6, 7, 9, 10)] == [0, 0, 0, 1, 1]
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_secrets(spark):
    got = rows(secrets.digest(odd.documents(spark)))
    assert got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[5]["spans"] == ""
    assert (got[13]["n_assign"], got[13]["n_access"], got[13]["n_hex"]) == (1, 1, 0)
    assert [x.split(":")[0] for x in got[13]["spans"].split(",")] == ["assign", "guess", "access"]


def test_quality(spark):
    got = rows(quality.digest(odd.documents(spark)))
    assert got[5]["n_words"] == got[6]["n_words"] == got[7]["n_words"] == 0 and got[5]["base_failed"] and not got[5]["kept"]


def test_pieces(spark):
    got = rows(pieces.digest(odd.documents(spark)))
    assert all(r["lossless"] for r in got.values()) and got[5]["pieces"] is None and got[6]["pieces"] == []
    twins = [r["pieces"] for r in pieces.digest(odd.documents(spark)).where("doc_id = 2").collect()]
    assert twins[0] == twins[1]


def test_vectors(spark):
    got = vectors.digest(odd.vectors(spark)).collect()
    by = {r["vec_id"]: r for r in got}
    assert [by[i]["component_id"] for i in range(13)] == [0, 0, 0, 3, 4, 5, 6, 7, 8, 9, 10, 0, 12]
    assert [by[i]["n_links"] for i in range(13)] == [5, 5, 5, 0, 0, 0, 0, 0, 0, 0, 0, 5, 0]


def test_extraction(spark):
    got = rows(extraction.digest(odd.pages(spark)), "page_id")
    assert got[3]["text"] == "Head One two three four five. Six & seven" and got[4]["text"] == got[5]["text"] == "" and got[4]["n_chars"] == 0
    assert got[7]["text"].count("words.") == 20_000


def test_warc(spark):
    got = [tuple(r) for r in warc.digest(odd.pages(spark)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    length = next(n for i, n, *_ in got if i == 3)
    assert {(3, length, "revisit", 1), (1, length, "response", None), (None, length, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4)} <= set(got)


@pytest.mark.parametrize("number", range(4))
def test_stage_keeps_columns(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = odd.documents(spark)
    got = stage(spark, docs, "")
    assert got.dtypes == docs.dtypes and stage(spark, docs.limit(0), "").collect() == []
    ids = sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=str)
    if name == "near_duplicates":
        assert ids == sorted([1, 4, 5, 6, 7, 8, 9, 10, 11, None, 12, 13, 14], key=str)
    elif name != "language_id":
        assert ids == sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    else:
        assert not {5, 6, 7, 8} & set(ids)


def test_last_stage(spark):
    got = corpus_pipeline.STAGES[-1][1](spark, odd.documents(spark), "")
    assert got.where("NOT lossless").isEmpty()
