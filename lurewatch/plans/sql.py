"""Pieces of DuckDB SQL for the oracle texts: the derived views and the small functions."""

from __future__ import annotations

import re

from lurewatch import reference_lists as lists
from lurewatch.plans.registry import oracle_view
from lurewatch.sources.lures import COLUMNS, DEPARTMENTS, FIRST_NAMES, KINDS, LURES
from lurewatch.sources.tables import ACTIONS, EVIDENCE_KINDS, INTERACTIONS

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"^({OCTET}\\.){{3}}{OCTET}$"
NOT_WORD = r"[^\p{L}\p{N}_]"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_in(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def is_ip(host: str) -> str:
    return f"(regexp_matches({host}, '{IPV4}') OR contains({host}, ':'))"


def last_labels(host: str, n: int) -> str:
    return f"array_to_string(string_split({host}, '.')[-{n}:], '.')"


def reg(host: str) -> str:
    return (f"CASE WHEN {is_ip(host)} THEN {host} WHEN {last_labels(host, 2)} IN {values_in(lists.MULTI_PART_SUFFIXES)} "
            f"THEN {last_labels(host, 3)} ELSE {last_labels(host, 2)} END")


def authority(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def host(url: str) -> str:
    place = f"regexp_replace({authority(url)}, '^.*@', '')"
    return f"rtrim(lower(regexp_replace({place}, ':[0-9]*$', '')), '.')"


def domain(address: str) -> str:
    return f"CASE WHEN contains({address}, '@') THEN lower(trim(regexp_extract({address}, '@([^@]*)$', 1))) ELSE '' END"


def words(phrases) -> str:
    """RE2 pattern of whole words; groups stand for the looks to the left and right."""
    return f"(?i)(^|{NOT_WORD})(" + "|".join(r"\s+".join(map(re.escape, p.split())) for p in phrases) + f")($|{NOT_WORD})"


def loose(phrase: str) -> str:
    return r"[\s-]*".join(re.escape(w) for w in re.split(r"[\s-]+", phrase) if w)


def loose_words(phrases) -> str:
    return f"(?i)(^|{NOT_WORD})(" + "|".join(map(loose, phrases)) + f")($|{NOT_WORD})"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


_GROUP = "CAST(doc_id // 96 AS VARCHAR)"
_SPREAD = "CAST((doc_id // 384) * 5 + (doc_id // 24) % 5 AS VARCHAR)"


def _filled(column: str) -> str:
    return f"replace(replace({column}, '{{g}}', {_GROUP}), '{{p}}', {_SPREAD})"


def employee_name(key: str) -> str:
    return f"({array(FIRST_NAMES)}[CAST({key} % {len(FIRST_NAMES)} AS INTEGER) + 1] || ' Vale' || CAST({key} AS VARCHAR))"


def _employee_reversed(key: str) -> str:
    return f"('Vale' || CAST({key} AS VARCHAR) || ', ' || {array(FIRST_NAMES)}[CAST({key} % {len(FIRST_NAMES)} AS INTEGER) + 1])"


oracle_view("v_size", "SELECT (SELECT count(*) FROM documents) AS n_messages, (SELECT count(*) FROM customer) AS n_employees, "
            "(SELECT count(*) FROM customer) AS n_recipients")
oracle_view("v_lure", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in LURES)
            + ") AS t(" + ", ".join("lure_kind" if c == "kind" else c for c in COLUMNS) + ")")
oracle_view("v_employee", f"""
SELECT c_custkey AS employee_id, {employee_name('c_custkey')} AS name,
       'user' || CAST(c_custkey AS VARCHAR) || '@{lists.ORG_DOMAIN}' AS email,
       {array(DEPARTMENTS)}[CAST(c_nationkey % 6 AS INTEGER) + 1] AS department,
       upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, c_custkey % 50 = 0 AS is_admin
FROM customer""")
oracle_view("v_message", f"""
SELECT doc_id AS message_id, lure_kind AS kind, source, lang, subject,
  text || chr(10) || sentence || coalesce(' ' || {_filled('url')}, '') || coalesce(' ' || {_filled('text_url')}, '')
    || chr(10) || chr(10) || signature AS body_text,
  '<html><head><title>mail</title></head><body><p>' || sentence || '</p><p><a href="' || {_filled('url')} || '">'
    || {_filled('anchor')} || '</a></p></body></html>' AS body_html,
  sentence, signature,
  {_filled('sender')} AS sender,
  replace(replace(sender_name, '{{e}}', {employee_name('((doc_id * 7) % n_employees)')}), '{{r}}', {_employee_reversed('((doc_id * 7) % n_employees)')}) AS sender_name,
  {_filled('reply_to')} AS reply_to, {_filled('return_path')} AS return_path, auth, hop_ip,
  {_filled('url')} AS url, {_filled('anchor')} AS anchor, {_filled('text_url')} AS text_url,
  filename, content_type, encrypted, CAST(length(text) AS INTEGER) AS size_bytes,
  doc_id % n_recipients AS recipient_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 1800) % 345600) AS received_at
FROM documents JOIN v_lure ON doc_id % {KINDS} = lure_kind, v_size""")
oracle_view("v_link", f"""
SELECT *, {host('url')} AS host FROM (
  SELECT message_id, 0 AS pos, url, anchor AS anchor_text, 'html' AS found_in FROM v_message WHERE url IS NOT NULL
  UNION ALL
  SELECT message_id, CASE WHEN url IS NULL THEN 0 ELSE 1 END, text_url, NULL, 'text' FROM v_message WHERE text_url IS NOT NULL)""")
oracle_view("v_url", "SELECT 'm' || message_id || '-' || pos AS link_id, url FROM v_link "
            "UNION ALL SELECT 'p' || page_id, url FROM pages")
oracle_view("v_fact", f"""
SELECT *, {reg('domain')} AS reg, {reg('reply_domain')} AS reply_reg, {reg('return_domain')} AS return_reg
FROM (SELECT *, {domain("coalesce(sender, '')")} AS domain, {domain("coalesce(reply_to, '')")} AS reply_domain,
        {domain("trim(coalesce(return_path, ''), '<>')")} AS return_domain FROM v_message)""")
oracle_view("v_linkfact", f"""
SELECT *, {reg('host')} AS reg,
  CASE WHEN {is_ip('host')} THEN host
       WHEN regexp_matches(host, '^[0-9]{{1,10}}$') AND CAST(host AS BIGINT) <= 4294967295 THEN
         CAST(CAST(host AS BIGINT) // 16777216 AS VARCHAR) || '.' || CAST(CAST(host AS BIGINT) // 65536 % 256 AS VARCHAR) || '.'
         || CAST(CAST(host AS BIGINT) // 256 % 256 AS VARCHAR) || '.' || CAST(CAST(host AS BIGINT) % 256 AS VARCHAR) END AS ip,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract({authority('url')}, '^(.*)@[^@]*$', 1) AS userinfo
FROM v_link""")
_cases = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in EVIDENCE_KINDS.items())
oracle_view("v_evidence", f"""
SELECT event_id AS evidence_id, kind, user_id AS employee_id,
  CASE WHEN kind IN ('email_scored', 'link_clicked', 'user_report') THEN event_id % n_messages END AS message_id,
  CASE WHEN kind = 'password_reuse' THEN CASE WHEN event_id % 5 = 0
       THEN {array(lists.APPROVED_LOGINS)}[CAST(event_id % {len(lists.APPROVED_LOGINS)} AS INTEGER) + 1]
       ELSE 'login.micr0soft-alerts' || CAST(event_id % 10 AS VARCHAR) || '.test' END END AS domain,
  CASE WHEN kind = 'user_report' THEN 'reported' ELSE 'automatic' END AS source, ts,
  CASE WHEN kind = 'user_report' THEN {array(INTERACTIONS)}[CAST(event_id % 5 AS INTEGER) + 1] END AS interaction_kind
FROM (SELECT *, CASE event_type {_cases} END AS kind FROM events), v_size""")
oracle_view("v_action", f"""
SELECT o_orderkey AS action_id, {array(ACTIONS)}[CAST(o_orderkey % 9 AS INTEGER) + 1] AS action,
  (o_orderkey * 13) % n_messages AS message_id, (o_orderkey * 11) % n_recipients AS employee_id,
  o_custkey % n_employees AS approved_by, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((o_orderkey * 977) % 345600) AS acted
FROM orders, v_size""")
oracle_view("v_labelled", "SELECT doc_id, text, source, toxic AS label, quality FROM labels JOIN documents USING (doc_id)")
