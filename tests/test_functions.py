"""Literal tables for the scalar functions."""

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import domains as dom
from lurewatch.functions import files, mailauth
from lurewatch.functions import text as txt
from lurewatch.functions import urls as url_fn
from lurewatch.operators import rules
from lurewatch.sources.mailfiles import parse_mail, read_eml


def values(spark, rows, build):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


def test_registrable(spark):
    cases = {"login.shop.example": "shop.example", "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "10.1.2.3": "10.1.2.3", "HOST.": "host"}
    assert values(spark, list(cases), dom.registrable) == list(cases.values())


def test_punycode_like_the_codec(spark):
    plain = ["bücher", "例子", "mіcrosoft", "пример", "café-bar", "ελληνικά"]
    coded = ["xn--" + p.encode("punycode").decode() for p in plain]
    assert values(spark, coded, dom.decoded_host) == plain


@pytest.mark.parametrize("a,b,one", [("microsfot", "microsoft", True), ("micrsoft", "microsoft", True), ("dhl", "dhl", False),
                                     ("abcd", "badc", False), ("axb", "ab", True), ("ab", "cd", False)])
def test_one_edit(spark, a, b, one):
    assert spark.range(1).select(dom.one_edit_apart(F.lit(a), F.lit(b))).first()[0] is one


def test_url_parts(spark):
    urls = ["https://user:pw@Shop.Example:8080/a/b?x=1#y", "http://[2001:db8::1]/p", "mailto:x@y.example", "http://a.example."]
    assert values(spark, urls, url_fn.host) == ["shop.example", "2001:db8::1", "", "a.example"]
    assert values(spark, urls[:1], url_fn.userinfo) == ["user:pw"]
    assert values(spark, urls[:1], url_fn.query) == ["x=1"]


def test_file_names(spark):
    assert values(spark, ["plan‮fdp.exe"], files.visible_name) == ["planexe.pdf"]
    assert values(spark, ["Report.PDF.exe. "], lambda c: files.extension(files.checked_name(c))) == ["exe"]


def test_auth_results(spark):
    def verdict(*headers):
        rows = [([("Authentication-Results", h) for h in headers],)]
        df = spark.createDataFrame(rows, "headers array<struct<name:string,value:string>>")
        return tuple(df.select(*[mailauth.verdict(F.col("headers"), m) for m in mailauth.MECHANISMS]).first())

    assert verdict("mx; spf=hardfail (a; dmarc=pass (b)); dkim=fail; dkim=pass") == ("fail", "pass", None)
    assert verdict("mx; dmarc=fail", "old; dmarc=pass; spf=softfail") == ("softfail", None, "fail")
    for depth in (3, 5, 12, 40):
        inner = "(x; dmarc=pass " * depth + ")" * depth
        assert verdict(f"mx {inner}; dmarc=fail (a{inner})") == (None, None, "fail")
    assert verdict("mx (open; dmarc=fail") == (None, None, "fail")  # a bracket without its partner hides nothing


@pytest.mark.parametrize("host,key,trick", [
    ("micr0soft-help.test", "microsoft", "the letter 'o' was replaced by the digit '0'"),
    ("microsfot.test", "microsoft", "the letters 'of' were swapped"), ("swiftbax.test", "swiftbox", "the letter 'o' was replaced by 'a'"),
    ("microsoft-online.test", "microsoft", ""), ("microsoft.com", None, None), ("dhx.test", None, None), ("10.0.0.1", None, None)])
def test_lookalikes(spark, host, key, trick):
    found = spark.range(1).select(rules.lookalike_of(F.lit(host)).alias("m")).first()["m"]
    assert (found and found["key"], found and found["trick"]) == (key, trick)


def test_wording_exceptions(spark):
    texts = ["This is urgent.", "It is not urgent.", "Sign in here", "no action required", "Action  required", "send me the code review"]
    urgent = values(spark, texts, lambda c: c.rlike(txt.category_pattern("urgency")))
    assert urgent == [True, False, False, False, True, False]
    assert not values(spark, texts[-1:], lambda c: c.rlike(txt.category_pattern("mfa_code_request")))[0]


def test_anchor_words_never_lose_a_match(spark):
    """Every phrase, written with odd spacing, passes the substring search that guards its pattern."""
    from lurewatch import reference_lists as lists

    for category, phrases in lists.CONTENT_PHRASES.items():
        texts = [f"x {p.replace(' ', '  ').upper()} y" for p in phrases]
        anchors = txt.category_anchors(category)
        assert all(values(spark, texts, lambda c: c.rlike(txt.category_pattern(category)))), category
        assert all(values(spark, texts, lambda c: txt.may_contain(F.lower(c), anchors))), category


def test_long_sentence_is_cut_around_the_match(spark):
    text = "word " * 40 + "buy a gift card today " + "tail " * 40
    out = values(spark, [text], lambda c: txt.quote_around(c, F.lit("gift card")))[0]
    assert len(out) <= 120 and "gift card" in out and out.startswith("…") and out.endswith("…")


def test_json_object(spark):
    texts = ['ok {"a": 1} end', '{"a": 1}}', "none", '{"a": "}"}']
    assert values(spark, texts, txt.json_object) == ['{"a": 1}', None, None, '{"a": "}"}']


def test_parse_mail(tmp_path, spark):
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"] = "Ann <Ann@Desk.Example>", "b@x.example, B@x.example", "Grüße"
    mail.set_content("hello")
    mail.add_alternative("<p>hello <a href='http://x.example'>x</a></p>", subtype="html")
    mail.add_attachment(b"PK\x03\x04", maintype="application", subtype="zip", filename="a.zip")
    row = parse_mail(bytes(mail))
    assert (row["sender"], row["recipients"], row["subject"], row["attachments"][0]["filename"]) == (
        "ann@desk.example", ["b@x.example"], "Grüße", "a.zip")
    (tmp_path / "a.eml").write_bytes(bytes(mail))
    (tmp_path / "b.eml").write_bytes(b"%PDF no mail")
    found = {r["error"]: r["sender"] for r in read_eml(spark, str(tmp_path)).collect()}
    assert found == {None: "ann@desk.example", "not a mail": None}


def test_long_names(spark):
    people = spark.createDataFrame([(1, "Ana Maria van der Berg", "CFO"), (2, "Li Wu", "CTO")], "employee_id long, name string, title string")
    mails = ["Ana Maria van der Berg", "Berg, Ana Maria van der (CFO)", "maria van der berg", "Ana van der Berg", "wu li", "Mr Li Wu Jr"]
    rows = [(i, "x@free.test", name) for i, name in enumerate(mails)]
    hits = rules.colleague_hits(spark.createDataFrame(rows, "message_id long, sender string, sender_name string"), people)
    assert sorted(r["message_id"] for r in hits.collect()) == [0, 1, 4, 5]


def test_quotes(spark):
    def quoted(sentence, matched):
        return spark.range(1).select(txt.quote_around(F.lit(sentence), F.lit(matched), 40)).first()[0]

    assert quoted("a short one:", "short") == "a short one"
    text = " ".join(f"word{i}" for i in range(30))
    got = quoted(text, "word15")
    assert got.startswith("…") and got.endswith("…") and "word15" in got and len(got) <= 40
    assert all(w in text.split() for w in got.strip("…").split())
    assert quoted("x" * 100, "x") == "x" * 38 + "…"


def test_references(spark):
    assert values(spark, ["verify&#32;your&nbsp;a&eacute;&amp;b", "plain", None], txt.unescaped) == ["verify your\u00a0aé&b", "plain", None]


def test_emoji_label(spark):
    coded = "xn--" + "a😀b".encode("punycode").decode()
    assert values(spark, [coded, "xn--" + ("ü" * 60).encode("punycode").decode()], dom.decoded_host) == ["a😀b", "ü" * 60]


def test_html_only_mail():
    row = parse_mail(b"From: A <a@x.test>\r\nSubject: s\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                     b"<p>Hello<br>there<a href=http://one.test/x>go<p><a href='&#104;ttp://two.test'><img alt=pic></a>")
    assert row["body_text"].split("\n") == ["Hello", "therego"]
    assert [(u["url"], u["anchor_text"]) for u in row["urls"]] == [("http://one.test/x", "go"), ("http://two.test", "pic")]
    assert row["received_at"] is None and row["message_key"].startswith("eml-")
