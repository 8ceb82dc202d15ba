"""Queries that show the scalar functions on whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch import reference_lists as lists
from lurewatch.functions import domains as dom
from lurewatch.functions import files
from lurewatch.functions import text as txt
from lurewatch.functions import urls as url_fn
from lurewatch.operators import rules
from lurewatch.plans import sql
from lurewatch.plans.registry import oracle_view, query
from lurewatch.sources.mailfiles import Reader
from lurewatch.sources.mailfiles import links as mail_links

DEMO_SITE = "http://localhost:8000/demo"


def on_links(name: str, oracle: str | None, out: str, build) -> None:
    query(name, oracle)(lambda t: t.links.select("link_id", build(F.col("url")).alias(out)))


def received_at(date: Column, ingested: Column) -> Column:
    """A Date header as a time; the ingest time when it cannot be read. Without a zone it is UTC."""
    plain = F.regexp_replace(F.trim(date), r"^[A-Za-z]{3},\s*|\s*\([^)]*\)$", "")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss")), ingested
    )


_H = sql.host("url")
oracle_view("v_urlhost", f"SELECT link_id, url, {_H} AS host FROM v_url")
query("fn_domain_of", f"SELECT message_id, {sql.domain('sender')} AS domain FROM v_message")(
    lambda t: t.messages.select("message_id", dom.domain_of(F.col("sender")).alias("domain")))
on_links("fn_registrable", f"SELECT link_id, {sql.reg('host')} AS site FROM v_urlhost", "site", lambda u: dom.registrable(url_fn.host(u)))
on_links("fn_registered_domain", f"SELECT link_id, {sql.last_labels('host', 2)} AS site FROM v_urlhost", "site",
         lambda u: dom.registered_domain(url_fn.host(u)))
on_links("fn_url_host", "SELECT link_id, host FROM v_urlhost", "host", url_fn.host)
query("fn_url_parts", f"""
SELECT link_id, coalesce(regexp_extract({sql.authority('url')}, '^(.*)@', 1), '') AS userinfo,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM v_url""")(
    lambda t: t.links.select("link_id", url_fn.userinfo(F.col("url")).alias("userinfo"), url_fn.path(F.col("url")).alias("path"),
                             url_fn.query(F.col("url")).alias("query")))
query("fn_ip_literal", "SELECT message_id, pos, ip FROM v_linkfact WHERE ip IS NOT NULL")(
    lambda t: t.message_links.select("message_id", "pos", dom.ip_literal(url_fn.host(F.col("url"))).alias("ip")).where("ip is not null"))
query("fn_punycode")(lambda t: t.links.select("link_id", dom.decoded_host(url_fn.host(F.col("url"))).alias("host")))
on_links("fn_normalize_url", "SELECT link_id, rtrim(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '/') AS url FROM v_url",
         "url", url_fn.normalized)
query("fn_listed_suffix", f"SELECT link_id, d AS listed FROM v_urlhost, (SELECT unnest({sql.array(lists.BLOCKLIST_DOMAINS)}) AS d) "
      "WHERE host = d OR ends_with(host, '.' || d)")(
    lambda t: t.links.select("link_id", F.get(F.filter(dom.suffixes(url_fn.host(F.col("url"))),
                                                       lambda s: s.isin(lists.BLOCKLIST_DOMAINS)), F.lit(0)).alias("listed")).where("listed is not null"))
_NORM = "translate(replace(replace(replace(lower(host), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), " + f"'{lists.LOOKALIKE_CHARS}', '{lists.LOOKALIKE_FOR}')"
on_links("fn_homoglyph", f"SELECT link_id, {_NORM} AS plain FROM v_urlhost", "plain", lambda u: dom.undo_homoglyphs(url_fn.host(u)))
_LABELS = "SELECT DISTINCT string_split(host, '.')[1] AS label FROM v_urlhost WHERE host <> ''"
query("fn_osa_one", f"SELECT label, n AS name FROM ({_LABELS}) l, (SELECT unnest({sql.array(sorted({n for *_, n in rules.trusted_names()}))}) AS n) "
      "WHERE damerau_levenshtein(label, n) = 1")(
    lambda t: t.links.select(F.substring_index(url_fn.host(F.col("url")), ".", 1).alias("label")).where("label <> ''").distinct()
    .select("label", F.explode(F.array(*map(F.lit, sorted({n for *_, n in rules.trusted_names()})))).alias("name"))
    .where(dom.one_edit_apart(F.col("label"), F.col("name"))))
query("fn_edit_describe")(lambda t: t.links.select(F.substring_index(url_fn.host(F.col("url")), ".", -2).alias("site")).distinct()
                          .select("site", rules.lookalike_of(F.col("site")).alias("m")).where("m is not null")
                          .select("site", "m.key", "m.trick"))
query("fn_squash", "SELECT message_id, regexp_replace(lower(subject), '[\\s-]', '', 'g') AS squashed FROM v_message")(
    lambda t: t.messages.select("message_id", dom.squash(F.col("subject")).alias("squashed")))
query("fn_phrase_regex", f"SELECT message_id, regexp_matches(body_text, {sql.lit(sql.loose_words(lists.CONTENT_PHRASES['gift_card']))}) AS hit FROM v_message")(
    lambda t: t.messages.select("message_id", F.col("body_text").rlike(txt.category_pattern("gift_card")).alias("hit")))


def _sentence(t):
    at = F.regexp_instr(F.col("body_text"), F.lit(txt.category_pattern("gift_card")))
    return t.messages.withColumn("at", at).where("at > 0").select(
        "message_id", txt.one_line(txt.sentence_at(F.col("body_text"), F.col("at"))).alias("sentence"))


_CUT = "regexp_replace(regexp_replace(regexp_replace(body_text, '([.!?])[\\s\\p{Z}]+', '\\1' || chr(1), 'g'), ':[ \\t]*\\n', ':' || chr(1), 'g'), '\\n[ \\t]*\\n', chr(1), 'g')"
_ONE = lambda x: f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
query("fn_sentence_at", f"SELECT message_id, {_ONE('s')} AS sentence FROM (SELECT message_id, list_filter(string_split({_CUT}, chr(1)), "
      "lambda s: regexp_matches(s, '(?i)\\bgift cards?\\b'))[1] AS s FROM v_message) WHERE s IS NOT NULL")(_sentence)
query("fn_quote", f"SELECT message_id, CASE WHEN length(q) <= 60 THEN q ELSE rtrim(q[:59]) || '…' END AS quote FROM (SELECT message_id, {_ONE('body_text')} AS q FROM v_message)")(
    lambda t: t.messages.select("message_id", txt.quote(F.col("body_text")).alias("quote")))
query("fn_visible_filename", """
SELECT message_id, CASE WHEN contains(filename, chr(8238)) THEN split_part(filename, chr(8238), 1) || reverse(split_part(filename, chr(8238), 2)) ELSE filename END AS shown
FROM v_message WHERE filename IS NOT NULL""")(
    lambda t: t.attachments.select("message_id", files.visible_name(F.col("filename")).alias("shown")))
query("fn_extension", "SELECT message_id, regexp_extract(lower(filename), '([^.]*)$', 1) AS ext FROM v_message WHERE filename IS NOT NULL")(
    lambda t: t.attachments.select("message_id", files.extension(files.checked_name(F.col("filename"))).alias("ext")))
query("fn_signature_lines", "SELECT message_id, array_to_string(signed, ' / ') AS signed FROM v_signed")(
    lambda t: t.messages.select("message_id", F.array_join(txt.signature_lines(F.col("body_text")), " / ").alias("signed")))
query("fn_shown_hosts", f"""
SELECT message_id, pos, array_to_string(list_filter(regexp_extract_all(lower(anchor_text), '([a-z0-9-]+\\.)+[a-z]{{2,24}}'),
  lambda h: regexp_extract(h, '[a-z]+$') IN {sql.values_in(lists.SHOWN_TLDS)}), ',') AS shown FROM v_link WHERE anchor_text IS NOT NULL""")(
    lambda t: t.message_links.where("anchor_text is not null").select("message_id", "pos", F.array_join(url_fn.shown_hosts(F.col("anchor_text")), ",").alias("shown")))
oracle_view("v_masked", """
SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://[^\\s\\p{Z}]+|www\\.[^\\s\\p{Z}]+)', ' URLTOKEN ', 'g'),
  '[\\p{L}\\p{M}\\p{N}_.+-]+@[\\p{L}\\p{M}\\p{N}_-]+\\.[\\p{L}\\p{M}\\p{N}_.-]*[\\p{L}\\p{M}\\p{N}_]', ' EMAILTOKEN ', 'g'), '[0-9]+', '0', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))) AS text
FROM documents""")
query("fn_text_normalize", "SELECT doc_id, md5(text) AS text FROM v_masked")(
    lambda t: t.read("documents").select("doc_id", F.md5(txt.masked(F.col("text"))).alias("text")))
query("fn_mail_text", "SELECT message_id, md5(subject || ' ' || chr(10) || ' ' || body_text) AS text FROM v_message")(
    lambda t: t.messages.select("message_id", F.md5(txt.mail_text(F.col("subject"), F.col("body_text"))).alias("text")))
oracle_view("v_dword", """
SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), 'https?://[^\\s\\p{Z}]+', ' ', 'g'), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM documents) WHERE len(w) > 0)""")
query("fn_shingles", "SELECT doc_id, count(*) AS n, min(s) AS first FROM v_dword GROUP BY doc_id")(
    lambda t: t.read("documents").select("doc_id", txt.shingles(F.col("text")).alias("s")).where(F.size("s") > 0).select(
        "doc_id", F.size("s").cast("bigint").alias("n"), F.array_min("s").alias("first")))


def _neighbours(t):
    docs = t.read("documents").select("doc_id", txt.shingles(F.col("text")).alias("s"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("o"))
    return docs.join(other, "doc_id").select("doc_id", F.round(txt.jaccard(F.col("s"), F.col("o")), 6).alias("similarity"))


query("fn_jaccard", """
SELECT a.doc_id, round(coalesce(shared / (a.n + b.n - shared), 0), 6) AS similarity
FROM (SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_dword GROUP BY 1) USING (doc_id)) a
JOIN (SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_dword GROUP BY 1) USING (doc_id)) b ON b.doc_id = a.doc_id + 1
LEFT JOIN (SELECT x.doc_id, count(*) AS shared FROM v_dword x JOIN v_dword y ON y.doc_id = x.doc_id + 1 AND y.s = x.s GROUP BY 1) s ON s.doc_id = a.doc_id""")(_neighbours)
_TOKENS = lambda x: (f"list_distinct(list_concat(list_transform(regexp_extract_all({x}, '(?i)\\b(?:[a-z0-9-]+\\.)+[a-z]{{2,}}\\b'), lambda d: lower(d)), "  # noqa: E731
                     f"regexp_extract_all({x}, '[0-9]+(?:[.,][0-9]+)?')))")
oracle_view("v_fact_tokens", f"SELECT doc_id, {_TOKENS('text')} AS tokens FROM documents")
query("fn_fact_tokens", "SELECT doc_id, array_to_string(list_sort(tokens), ' ') AS tokens FROM v_fact_tokens")(
    lambda t: t.read("documents").select("doc_id", F.array_join(F.array_sort(txt.fact_tokens(F.col("text"))), " ").alias("tokens")))
query("fn_ngrams_in_text")(lambda t: t.messages.select("message_id", F.array_join(
    rules.phrases_found(F.col("body_text"), "mfa_code_request"), "; ").alias("phrases")).where("phrases <> ''"))

_DUR = lambda d: (f"CASE WHEN {d} < 60 THEN {d} || ' seconds' WHEN {d} < 3600 THEN ({d} // 60) || ' minutes' ELSE ({d} // 3600) || ' hours' END")
query("fn_duration_text", f"SELECT event_id, {_DUR('s')} AS text FROM (SELECT event_id, epoch(ts)::BIGINT % 200000 AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))")(
    lambda t: t.read("events").select("event_id", txt.duration(F.unix_timestamp("ts") % 200000).alias("text")))
query("fn_percent", "SELECT o_orderkey, CAST(round_even(100.0 * (o_orderkey % 8) / 8, 0) AS INTEGER) AS percent FROM orders")(
    lambda t: t.read("orders").select("o_orderkey", txt.percent(F.col("o_orderkey") % 8, F.lit(8)).alias("percent")))
_ANSWER = "CASE WHEN event_id % 3 = 0 THEN 'Sure: ' || props || ' done' WHEN event_id % 3 = 1 THEN props || '}' ELSE 'no answer' END"
query("fn_json_extract", "SELECT event_id, CAST(props ->> 'k' AS VARCHAR) AS k FROM events WHERE event_id % 3 = 0")(
    lambda t: t.read("events").select("event_id", F.get_json_object(txt.json_object(F.expr(_ANSWER)), "$.k").alias("k")).where("k is not null"))
query("fn_fingerprint", "SELECT event_id, sha256(event_type || chr(31) || props)[:24] AS fingerprint FROM events")(
    lambda t: t.read("events").select("event_id", txt.fingerprint(F.col("event_type"), F.col("props")).alias("fingerprint")))
query("fn_short_strings", """
SELECT doc_id, array_to_string(list_transform(l, lambda s: trim(s)), '|') AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
WHERE len(l) <= 4 AND len(list_filter(l, lambda s: length(trim(s)) = 0 OR length(trim(s)) > 300)) = 0""")(
    lambda t: t.read("documents").select("doc_id", F.array_join(txt.short_strings(F.split("text", "\n"), 4, 300), "|").alias("lines")).where("lines is not null"))
query("fn_url_rewrite_target", f"""
SELECT link_id, '{DEMO_SITE}/' || host || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS target
FROM (SELECT link_id, host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM v_urlhost)
WHERE ends_with(host, '.example') OR ends_with(host, '.test')""")(
    lambda t: t.links.select("link_id", url_fn.demo_target(F.col("url"), DEMO_SITE).alias("target")).where("target is not null"))

# --- parts of a mail ------------------------------------------------------------------------------
query("parse_recipients", "SELECT message_id, 'user' || recipient_id || '@" + lists.ORG_DOMAIN + "' AS recipients FROM v_message")(
    lambda t: t.messages.select("message_id", F.array_join(F.array_distinct(F.transform(
        F.split(F.concat_ws(", ", F.array_join("recipients", ","), F.upper(F.array_join("recipients", ","))), ","),
        lambda a: F.lower(F.trim(a)))), ",").alias("recipients")))
query("received_at", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '2024-02-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS received_at FROM events")(
    lambda t: t.read("events").select("event_id", F.date_format(received_at(
        F.when(F.col("event_id") % 7 == 0, "no date").otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss Z")),
        F.lit("2024-02-01 00:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("received_at")))
query("message_key", "SELECT message_id, 'eml-' || sha256('<' || message_id || '@mail>|user' || recipient_id || '@" + lists.ORG_DOMAIN + "')[:16] AS key FROM v_message")(
    lambda t: t.messages.select("message_id", F.concat(F.lit("eml-"), F.substring(F.sha2(F.concat(
        F.lit("<"), F.col("message_id").cast("string"), F.lit("@mail>|"), F.array_join(F.array_sort("recipients"), ",")), 256), 1, 16)).alias("key")))
query("html_visible_text", """
SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(regexp_replace(s, '[\\s\\p{Z}]+', ' ', 'g'))), lambda s: s <> ''), chr(10))) AS text
FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'),
  '(?is)<head\\b[^>]*>.*?</head>|<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<!doctype[^>]*>', '', 'g'),
  '(?i)<br\\b[^>]*>|</(p|div|li|tr|td|th|table|blockquote|h[1-6])\\s*>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM pages)""")(
    lambda t: t.read("pages").select("page_id", F.md5(txt.visible_text(F.col("html"))).alias("text")))
_A = "(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
query("links_html", f"""
SELECT message_id, url, nullif(anchor, '') AS anchor FROM (SELECT message_id, regexp_extract(a, '{_A}', 1) AS url,
  trim(regexp_replace(regexp_extract(a, '{_A}', 2), '<[^>]*>', ' ', 'g')) AS anchor
  FROM (SELECT message_id, unnest(regexp_extract_all(body_html, '(?is)<a\\s[^>]*>.*?</a>')) AS a FROM v_message WHERE url IS NOT NULL))
WHERE url ILIKE 'http%'""")(lambda t: t.messages.where("body_html is not null").select("message_id", F.explode(html_links(F.col("body_html"))).alias("l"))
                            .select("message_id", "l.url", "l.anchor"))


_LINKS = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("anchor", T.StringType())]))


@F.pandas_udf(_LINKS)
def _page_links(pages: pd.Series) -> pd.Series:
    return pages.map(lambda html: None if html is None else [{"url": url, "anchor": anchor} for url, anchor in Reader.of(html).links]).astype(object)


def html_links(html: Column) -> Column:
    """Web links of <a href> with their text; a picture's alt text when there is no other."""
    links = F.transform(_page_links(html), lambda l: F.struct(url_fn.web_url(l["url"]).alias("url"), l["anchor"].alias("anchor")))
    return F.filter(links, lambda l: l["url"].isNotNull())


oracle_view("v_textlink", """
SELECT message_id, rtrim(u, '.,;:!?') AS url FROM (SELECT message_id, unnest(regexp_extract_all(body_text, '(?i)https?://[^\\s<>"'')\\]]+')) AS u FROM v_message)""")
query("links_text", "SELECT * FROM v_textlink")(
    lambda t: t.messages.select("message_id", F.explode(url_fn.urls_in_text(F.col("body_text"))).alias("url")))


def _deduped(t):
    """Each (address, text) of the HTML part once, and text links that it does not have; inside one row, so nothing is shuffled."""
    html = F.transform(_page_links(F.coalesce("body_html", F.lit(""))), lambda l: F.struct(l["url"].alias("url"), l["anchor"].alias("anchor_text")))
    return t.messages.select("message_id", F.explode(mail_links(html, F.col("body_text"))).alias("l")).select("message_id", "l.url", F.col("l.anchor_text").alias("anchor"))


query("link_dedupe", """
SELECT message_id, url, nullif(trim(anchor_text), '') AS anchor FROM v_link WHERE found_in = 'html'
UNION SELECT message_id, url, NULL FROM v_textlink x WHERE NOT EXISTS (SELECT 1 FROM v_link l WHERE l.message_id = x.message_id AND l.found_in = 'html' AND l.url = x.url)""")(_deduped)
