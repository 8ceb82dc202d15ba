"""Queries on signals and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch import wording
from lurewatch.functions import domains as dom
from lurewatch.functions import mailauth
from lurewatch.functions import text as txt
from lurewatch.functions import urls as url_fn
from lurewatch.operators import fusion, rules
from lurewatch.plans import sql
from lurewatch.plans.registry import oracle_view, query
from lurewatch.sources.tables import Tables

# --- oracle side: one view per rule --------------------------------------------------------------
_AUTH = {}
for _m in mailauth.MECHANISMS:
    _clean = "regexp_replace(" * 14 + "coalesce(auth, '')" + ", '\\([^()]*\\)', ' ', 'g')" * 14  # deeper than any lure
    _all = f"list_filter(list_transform(string_split({_clean}, ';'), lambda s: regexp_extract(lower(trim(s)), '^{_m}\\s*=\\s*([a-z]+)', 1)), lambda r: r <> '')"
    # The lower header of the relay says "pass" for everything and only speaks when the top one is silent.
    _AUTH[_m] = (f"CASE WHEN auth IS NULL THEN NULL WHEN len({_all}) = 0 THEN 'pass' WHEN list_contains({_all}, 'pass') THEN 'pass' "
                 f"WHEN {_all}[1] = 'hardfail' THEN 'fail' ELSE {_all}[1] END")
oracle_view("v_auth", "SELECT message_id, domain, " + ", ".join(f"{e} AS {m}" for m, e in _AUTH.items()) + " FROM v_fact")

_SIGNED = ("list_filter(list_transform(string_split(body_text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(160) || chr(12288))), "
           "lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^sent from my\\b'))")
oracle_view("v_signed", f"SELECT message_id, {_SIGNED}[-2:] AS signed FROM v_message")
_FREE = sql.values_in(lists.FREEMAIL)
oracle_view("v_named", " UNION ALL ".join(
    f"SELECT message_id, {i} AS ord, {sql.lit(key)} AS key, reg IN {sql.values_in(domains)} AND reg NOT IN {_FREE} AS official "
    f"FROM v_fact WHERE regexp_matches(coalesce(sender_name, ''), {sql.lit(sql.words(words))})"
    for i, (key, _, words, domains) in enumerate(lists.BRANDS)))

SIG: dict[str, str] = {}


def _sig(rule: str, category: str, severity, where_from: str) -> None:
    name = "v_sig_" + rule.replace(".", "_")
    oracle_view(name, f"SELECT message_id, '{rule}' AS rule_id, '{category}' AS category, CAST({severity} AS INTEGER) AS severity "
                f"{where_from}")
    SIG[rule] = name


_sig("header.auth", "auth_failure", "CASE WHEN dmarc = 'fail' OR spf = 'fail' THEN 2 ELSE 1 END",
     "FROM v_auth WHERE dmarc = 'fail' OR spf IN ('fail', 'softfail') OR dkim = 'fail'")
_sig("header.reply_to", "reply_to_mismatch", 2, "FROM v_fact WHERE domain <> '' AND reply_domain <> '' AND reg <> reply_reg")
_sig("header.return_path", "return_path_mismatch", 1, "FROM v_fact WHERE domain <> '' AND return_domain <> '' AND reg <> return_reg")
_sig("sender.brand_name", "brand_impersonation", 3,
     "FROM v_fact WHERE domain <> '' AND message_id IN (SELECT message_id FROM v_named) "
     "AND message_id NOT IN (SELECT message_id FROM v_named WHERE official)")
oracle_view("v_content_brand", "SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ord) AS rn FROM (" + " UNION ALL ".join(f"""
SELECT f.message_id, {i} AS ord, regexp_matches(array_to_string(s.signed, chr(10)), {sql.lit(sql.words(words))}) AS signed
FROM v_fact f JOIN v_signed s USING (message_id)
WHERE f.domain <> '' AND f.reg <> '{lists.ORG_DOMAIN}' AND f.message_id NOT IN (SELECT message_id FROM v_named)
  AND (regexp_matches(array_to_string(s.signed, chr(10)), {sql.lit(sql.words(words))}) OR regexp_matches(f.subject, {sql.lit(sql.words(words))}))
  AND NOT (f.reg IN {sql.values_in(domains)} AND f.reg NOT IN {_FREE})
  AND EXISTS (SELECT 1 FROM v_linkfact l WHERE l.message_id = f.message_id AND l.host <> '' AND l.reg NOT IN {sql.values_in(domains)})"""
    for i, (_, _, words, domains) in enumerate(lists.BRANDS)) + ")")
_sig("sender.brand_content", "brand_impersonation", "CASE WHEN signed THEN 2 ELSE 1 END", "FROM v_content_brand WHERE rn = 1")
_ROLE = [r"\b(" + "|".join(lists.ROLE_ACRONYMS) + r")\b", sql.words(lists.ROLE_PHRASES), sql.words(lists.BRANDS[1][2])]
_role = lambda x: "(" + " OR ".join(f"regexp_matches({x}, {sql.lit(p)})" for p in _ROLE) + ")"
_sig("sender.colleague_name", "colleague_impersonation", f"CASE WHEN reg IN {_FREE} THEN 3 ELSE 2 END", f"""
FROM v_fact WHERE domain <> '' AND reg <> '{lists.ORG_DOMAIN}' AND EXISTS (SELECT 1 FROM v_employee e WHERE
  lower(v_fact.sender_name) = lower(e.name)
  OR lower(v_fact.sender_name) = lower(regexp_replace(e.name, '^(\\S+) (.*)$', '\\2, \\1')))""")
_sig("sender.freemail_role", "freemail_impersonation", 2, f"""
FROM v_fact JOIN v_signed USING (message_id) WHERE reg IN {_FREE}
  AND ({_role("coalesce(sender_name, '')")} OR len(list_filter(signed, lambda s: {_role('s')})) > 0)
  AND message_id NOT IN (SELECT message_id FROM v_sig_sender_brand_name)
  AND message_id NOT IN (SELECT message_id FROM v_sig_sender_colleague_name)""")

# Look-alikes: hosts x trusted names as one relational product, with DuckDB's own edit distance.
_norm = lambda x: ("translate(" + "replace(" * 3 + f"lower({x})"
                   + "".join(f", '{a}', '{b}')" for a, b in lists.LOOKALIKE_PAIRS)
                   + f", '{lists.LOOKALIKE_CHARS}', '{lists.LOOKALIKE_FOR}')")
_TARGETS = ", ".join(f"({i}, {sql.lit(k)}, {sql.lit(w.replace('-', ''))}, {sql.lit(n)})"
                     for i, (k, _, w, n) in enumerate(rules.trusted_names()))
oracle_view("v_target", f"SELECT * FROM (VALUES {_TARGETS}) AS t(ord, key, written, norm)")
oracle_view("v_host", "SELECT DISTINCT host FROM (SELECT host FROM v_link UNION ALL SELECT rtrim(domain, '.') FROM v_fact) WHERE host <> ''")
oracle_view("v_candidate", f"""
SELECT host, text, whole, {_norm('text')} AS norm FROM (
  SELECT host, regexp_replace(label, '[\\s-]', '', 'g') AS text, TRUE AS whole FROM v_label
  UNION ALL SELECT host, unnest(list_filter(string_split(label, '-'), lambda t: t <> '')), FALSE FROM v_label WHERE contains(label, '-'))""")
oracle_view("v_label", f"""
SELECT host, CASE WHEN first_label = 'xn--mcrosoft-thh' THEN 'mіcrosoft' ELSE first_label END AS label
FROM (SELECT host, {sql.reg('host')} AS reg, string_split({sql.reg('host')}, '.')[1] AS first_label FROM v_host)
WHERE NOT {sql.is_ip('host')} AND reg NOT IN {sql.values_in(rules.REAL_DOMAINS)}""")
oracle_view("v_lookalike", f"""
SELECT c.host, c.text, t.key, t.written, t.norm AS target, c.norm,
  CASE WHEN c.norm = t.norm THEN 'same'
       WHEN length(t.norm) >= {lists.MIN_TYPO_LENGTH} AND damerau_levenshtein(c.norm, t.norm) = 1 THEN 'edit' ELSE 'embedded' END AS kind
FROM v_candidate c, v_target t
WHERE c.norm = t.norm OR (length(t.norm) >= {lists.MIN_TYPO_LENGTH} AND damerau_levenshtein(c.norm, t.norm) = 1)
   OR (c.whole AND length(t.norm) >= {lists.MIN_EMBEDDED_LENGTH} AND contains(c.norm, t.norm))""")
_sig("lookalike.sender", "lookalike_domain", 3, "FROM v_fact WHERE rtrim(domain, '.') IN (SELECT host FROM v_lookalike)")
_sig("lookalike.link", "suspicious_url", 3, "FROM (SELECT DISTINCT message_id FROM v_link WHERE host IN (SELECT host FROM v_lookalike))")


def _link(rule: str, severity: int, condition: str) -> None:
    _sig(rule, "suspicious_url", severity, f"FROM (SELECT DISTINCT message_id FROM v_linkfact WHERE host <> '' AND ({condition}))")


_SHOWN = ("list_filter(regexp_extract_all(lower(coalesce(anchor_text, '')), '([a-z0-9-]+\\.)+[a-z]{2,24}'), "
          f"lambda h: regexp_extract(h, '[a-z]+$') IN {sql.values_in(lists.SHOWN_TLDS)})")
_link("url.text_mismatch", 3, f"len({_SHOWN}) > 0 AND NOT list_contains(list_transform({_SHOWN}, lambda h: {sql.reg('h')}), reg)")
_link("url.at_sign", 3, "userinfo <> ''")
_link("url.ip_host", 2, "ip IS NOT NULL")
_FRONT = "'.' || host[:length(host) - length(reg) - 1] || '.'"
_DOMAIN_OWN = " OR ".join(
    f"(contains({_FRONT}, '.{d}.') AND reg NOT IN {sql.values_in(ds)})" for _, _, _, ds in lists.BRANDS for d in ds)
_link("url.brand_subdomain", 2, f"ip IS NULL AND ends_with(host, '.' || reg) AND ({_DOMAIN_OWN})")
_link("url.punycode", 2, "regexp_matches(host, '(^|\\.)xn--') OR regexp_matches(host, '[^\\x00-\\x7f]')")
_link("url.deep_subdomain", 1, "ip IS NULL AND len(string_split(host, '.')) - len(string_split(reg, '.')) >= 3")
_link("url.shortener", 1, f"host IN {sql.values_in(lists.SHORTENERS)} OR reg IN {sql.values_in(lists.SHORTENERS)}")
_link("url.login_path", 1, f"regexp_matches(lower(path), '(^|[^a-z])({lists.LOGIN_PATH.replace('?:', '')})')")
_sig("url.foreign_domain", "suspicious_url", 1, """
FROM v_fact f WHERE reg <> '' AND EXISTS (SELECT 1 FROM v_linkfact l WHERE l.message_id = f.message_id AND l.host <> '')
  AND NOT EXISTS (SELECT 1 FROM v_linkfact l WHERE l.message_id = f.message_id AND l.reg = f.reg)""")

# RE2 has no looking around: exceptions are cut out of the text first, word edges are written as groups.
_W = sql.NOT_WORD
_RE2 = {
    "urgency": [
        f"(?i)(^|{_W})urgent($|{_W})", f"(?i)(^|{_W})action\\s+required($|{_W})",
        f"(?i)(^|{_W})within\\s+\\d+\\s+(hours?|minutes?)($|{_W})",
        f"(?i)(^|{_W})(expires?|expiring|deactivated|suspended|disabled|locked|closed|deleted|returned|blocked)\\s+(in|within)\\s+\\d+\\s+(hours?|minutes?)($|{_W})",
    ],
    "credential_request": [
        f"(?i)(^|{_W})(sign|log)[\\s-]*in\\s+(here|now|below|at\\s+https?://)",
        f"(?i)(^|{_W})(sign|log)[\\s-]*in\\s+with\\s+(your\\s+(work\\s+|company\\s+|office\\s+|microsoft\\s+)?(email|account|password|credentials)|the\\s+account\\s+details)($|{_W})",
    ],
    "payment_change": [
        f"(?i)(^|{_W})(pay|transfer|send|remit)($|[^\\p{{L}}\\p{{N}}_.\\n])[^.\\n]{{0,60}}?to\\s+(the|our)\\s+new\\s+(bank\\s+)?account($|{_W})",
        f"(^|{_W})(?i:new|updated|changed|different)\\b[^.\\n]{{0,80}}?\\b[A-Z]{{2}}\\d{{2}}([ ]?[A-Z0-9]){{11,30}}\\b",
    ],
    "gift_card": [],
    "mfa_code_request": [
        f"(?i)(^|{_W})(send|give|text|forward)\\s+(me|us)\\s+(the|that|this)\\s+code($|{_W})",
        f"(?i)(^|{_W})(verification|security|login|sign-in|authentication|mfa|2fa|one-time)\\s+codes?\\s+(you\\s+received|we\\s+(just\\s+)?sent|sent\\s+to\\s+your)",
    ],
}
_PARTS = "subject || chr(10) || '.' || chr(10) || body_text || chr(10) || '.' || chr(10) || CASE WHEN url IS NULL THEN '' ELSE sentence END"
oracle_view("v_wording", f"""
SELECT message_id, regexp_replace(regexp_replace({_PARTS}, '(?i)not\\surgent', 'not', 'g'), '(?i)\\bno\\saction\\s+required', 'no', 'g') AS t
FROM v_message""")
for _c, _phrases in lists.CONTENT_PHRASES.items():
    _tests = " OR ".join(f"regexp_matches(t, {sql.lit(p)})" for p in [sql.loose_words(_phrases), *_RE2[_c]])
    _sig(f"content.{_c}", _c, lists.CONTENT_SEVERITY[_c], f"FROM v_wording WHERE {_tests}")

_VISIBLE = f"lower(trim(regexp_replace(filename, {sql.lit(lists.HIDDEN_CHAR_CLASS)}, '', 'g')))"
_STRIPPED = f"regexp_replace({_VISIBLE}, '[\\s.]+$', '')"
oracle_view("v_file", f"""
SELECT *, CASE WHEN len(bits) > 1 THEN bits[-1] ELSE '' END AS ext, CASE WHEN len(bits) > 2 THEN bits[-2] ELSE '' END AS inner_ext
FROM (SELECT message_id, filename, content_type, encrypted, size_bytes, string_split({_STRIPPED}, '.') AS bits,
        regexp_matches(subject || chr(10) || body_text,
          '(?i)\\b(password|passcode|pwd|has[łl]o)(\\s+(for|to|do)(\\s+\\w+){{1,2}})?\\s*(:|=|\\bis\\b|\\bto\\b)\\s*\\S+') AS password
      FROM v_message WHERE filename IS NOT NULL)""")
_RISKY = sql.values_in(sum(lists.RISKY_EXTENSIONS.values(), []))
_DECOY = sql.values_in(sum(lists.DECOY_EXTENSIONS.values(), []))
oracle_view("v_finding", f"""
SELECT message_id, CASE
  WHEN ext IN {_RISKY} AND (contains(filename, chr(8238)) OR inner_ext IN {_DECOY}) THEN 'attachment.double_extension'
  WHEN ext IN {_RISKY} THEN 'attachment.risky_extension'
  WHEN content_type IN {sql.values_in(lists.PROGRAM_TYPES)} THEN 'attachment.type_mismatch'
  WHEN ext IN {sql.values_in(lists.MACRO_EXTENSIONS)} THEN 'attachment.macro_office'
  WHEN ext IN {sql.values_in(lists.HTML_EXTENSIONS)} OR content_type IN {sql.values_in(lists.HTML_TYPES)} THEN 'attachment.html'
  WHEN encrypted OR (password AND (ext IN {sql.values_in(lists.ARCHIVE_EXTENSIONS)} OR content_type IN {sql.values_in(lists.ARCHIVE_TYPES)}))
    THEN 'attachment.encrypted_archive' END AS rule_id FROM v_file""")
for _r, _s in lists.ATTACHMENT_SEVERITY.items():
    _sig(_r, "risky_attachment", _s, f"FROM (SELECT DISTINCT message_id FROM v_finding WHERE rule_id = '{_r}')")

_below = lambda h: "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in lists.BLOCKLIST_DOMAINS) + ")"
_SENDERS = sql.values_in(s.lower() for s in lists.BLOCKLIST_SENDERS)
_IPS = sql.values_in(ip for ip in lists.BLOCKLIST_IPS if ip[0].isdigit())
_sig("intel.sender", "known_bad", 3, f"FROM v_fact WHERE sender IN {_SENDERS} OR coalesce(reply_to, '') IN {_SENDERS} "
     f"OR {_below('domain')} OR {_below('reply_domain')}")
_sig("intel.link", "known_bad", 3, "FROM (SELECT DISTINCT message_id FROM v_link WHERE "
     f"rtrim(regexp_replace(url, '^[^:]*://[^/]*', '') , '/') IN ('/get/7') AND host = 'files.quickdrop.test' OR {_below('host')})")
_sig("intel.ip", "known_bad", 3, f"FROM (SELECT message_id FROM v_message WHERE hop_ip IN {_IPS} UNION "
     f"SELECT message_id FROM v_link WHERE host IN {_IPS})")
oracle_view("v_signal", " UNION ALL ".join(f"SELECT * FROM {v}" for v in SIG.values()))

QUERY_NAMES = {
    "header.auth": "sig_header_auth", "header.reply_to": "sig_header_reply_to", "header.return_path": "sig_header_return_path",
    "sender.brand_name": "sig_sender_brand_name", "sender.brand_content": "sig_sender_brand_content",
    "lookalike.sender": "sig_lookalike_sender", "lookalike.link": "sig_lookalike_link",
    **{rule: f"sig_{rule.replace('.', '_')}" for rule, _, _ in rules.LINK_RULES},
    "url.foreign_domain": "sig_url_foreign_domain",
    "content.urgency": "sig_content_urgency", "content.credential_request": "sig_content_credential",
    "content.payment_change": "sig_content_payment", "content.gift_card": "sig_content_gift_card",
    "content.mfa_code_request": "sig_content_mfa",
    "attachment.double_extension": "sig_att_double_ext", "attachment.risky_extension": "sig_att_risky_ext",
    "attachment.type_mismatch": "sig_att_type_mismatch", "attachment.macro_office": "sig_att_macro",
    "attachment.html": "sig_att_html", "attachment.encrypted_archive": "sig_att_encrypted",
}
_COLUMNS = ["message_id", "rule_id", "category", "severity"]


def _register(rule: str, name: str) -> None:
    @query(name, f"SELECT * FROM {SIG[rule]}")
    def run(t: Tables) -> DataFrame:
        return rules.rule_signals(t.messages, rule).select(*_COLUMNS)


for _rule, _name in QUERY_NAMES.items():
    _register(_rule, _name)


def _long(t: Tables, only: str | None = None) -> DataFrame:
    long = t.detected.select("message_id", F.explode("signals").alias("s")).select("message_id", "s.*")
    return long if only is None else long.where(F.col("rule_id") == only)


@query("sig_sender_freemail_role", f"SELECT * FROM {SIG['sender.freemail_role']}")
def sig_sender_freemail_role(t: Tables) -> DataFrame:
    """Suppression looks at the colleague rule, so this one reads the merged signals."""
    return _long(t, "sender.freemail_role").select(*_COLUMNS)


@query("sig_sender_colleague", f"SELECT * FROM {SIG['sender.colleague_name']}")
def sig_sender_colleague(t: Tables) -> DataFrame:
    return rules.colleague_hits(t.messages, t.employees).select("message_id", "signal.*").select(*_COLUMNS)


def _intel(rule: str, name: str) -> None:
    @query(name, f"SELECT * FROM {SIG[rule]}")
    def run(t: Tables) -> DataFrame:
        hits = rules.intel_hits(t.messages, rules.blocklist(t.spark)).select("message_id", "signal.*")
        return hits.where(F.col("rule_id") == rule).select(*_COLUMNS)


for _rule in ("intel.sender", "intel.link", "intel.ip"):
    _intel(_rule, "sig_" + _rule.replace(".", "_"))


@query("unchecked_headers", f"""
SELECT message_id, {sql.lit(wording.NO_AUTH_RESULTS)} AS note FROM v_auth WHERE spf IS NULL AND dkim IS NULL AND dmarc IS NULL
UNION ALL SELECT message_id, replace({sql.lit(wording.NO_DMARC_POLICY)}, '{{domain}}', CASE WHEN domain = '' THEN {sql.lit(wording.SENDERS_DOMAIN)} ELSE domain END)
FROM v_auth WHERE dmarc = 'none'""")
def unchecked_headers(t: Tables) -> DataFrame:
    notes = rules.facts(t.messages).select("message_id", F.explode(rules.unchecked()).alias("note"))
    return notes.where(F.col("note") != wording.NO_SENDER)


@query("unchecked_sender", f"SELECT message_id, {sql.lit(wording.NO_SENDER)} AS note FROM v_fact WHERE domain = ''")
def unchecked_sender(t: Tables) -> DataFrame:
    return t.messages.where(dom.domain_of(F.col("sender")) == "").select("message_id", F.lit(wording.NO_SENDER).alias("note"))


@query("set_union_signals", "SELECT * FROM v_signal")
def set_union_signals(t: Tables) -> DataFrame:
    return _long(t).select(*_COLUMNS)


oracle_view("v_ranked", "SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY severity DESC, category, rule_id) AS rn FROM v_signal")


@query("agg_detect_merge", "SELECT message_id, string_agg(rule_id, ',' ORDER BY rn) AS rules, count(*) AS n FROM v_ranked GROUP BY message_id")
def agg_detect_merge(t: Tables) -> DataFrame:
    ordered = fusion.in_fusion_order(F.col("signals"))
    return t.detected.where(F.size("signals") > 0).select(
        "message_id", F.array_join(F.transform(ordered, lambda s: s["rule_id"]), ",").alias("rules"),
        F.size("signals").cast("bigint").alias("n"),
    )


query("ord_fusion_order", "SELECT message_id, rule_id, CAST(rn AS INTEGER) AS place FROM v_ranked")(
    lambda t: t.detected.select("message_id", F.posexplode(fusion.in_fusion_order(F.col("signals"))).alias("pos", "s")).select(
        "message_id", "s.rule_id", (F.col("pos") + 1).alias("place")))

oracle_view("v_strongest", "SELECT message_id, category, max(severity) AS severity FROM v_signal GROUP BY ALL")
query("agg_strongest_by_category", "SELECT * FROM v_strongest")(lambda t: fusion.strongest_by_category(_long(t)))

_imp = sql.values_in(lists.IMPERSONATION)
_imp_pay = sql.values_in([*lists.IMPERSONATION, "reply_to_mismatch", "return_path_mismatch"])
_has = lambda c, n: f"coalesce(max(severity) FILTER (category = '{c}'), 0) >= {n}"
oracle_view("v_floor", f"""
SELECT message_id, CAST(sum(CASE severity WHEN 3 THEN 6 WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END) AS INTEGER) AS score,
  max(severity) >= 2 AS moderate,
  {_has('credential_request', 2)} AND coalesce(max(severity) FILTER (category IN {_imp}), 0) >= 2 AS f1,
  {_has('known_bad', 3)} AS f2, {_has('mfa_code_request', 3)} AS f3,
  {_has('gift_card', 2)} AND {_has('colleague_impersonation', 2)} AS f4,
  {_has('payment_change', 2)} AND coalesce(max(severity) FILTER (category IN {_imp_pay}), 0) >= 2 AS f5
FROM v_strongest GROUP BY message_id""")
_FIRED = ", ".join(f"CASE WHEN f{i} THEN {sql.lit(n)} END" for i, n in enumerate(wording.FLOOR_RULES.values(), 1))
oracle_view("v_risk", f"""
SELECT m.message_id, m.recipient_id, m.received_at, coalesce(score, 0) AS score,
  CAST(CASE WHEN score IS NULL THEN 0 WHEN (score >= 6 OR f1 OR f2 OR f3 OR f4 OR f5) AND moderate THEN 2
            WHEN score >= 3 OR f1 OR f2 OR f3 OR f4 OR f5 THEN 1 ELSE 0 END AS INTEGER) AS risk,
  array_to_string(list_filter([{_FIRED}, CASE WHEN (score >= 6 OR f1 OR f2 OR f3 OR f4 OR f5) AND NOT moderate
    THEN {sql.lit(wording.CAP_RULE)} END], lambda x: x IS NOT NULL), '; ') AS rules_fired
FROM v_message m LEFT JOIN v_floor USING (message_id)""")
query("agg_risk_score", "SELECT message_id, score FROM v_risk")(lambda t: t.scored.select("message_id", "score"))
query("agg_risk_fusion", "SELECT message_id, risk, score, rules_fired FROM v_risk")(
    lambda t: t.scored.select("message_id", "risk", "score", F.array_join("rules_fired", "; ").alias("rules_fired")))
query("risk_levels", "SELECT risk, count(*) AS messages FROM v_risk GROUP BY risk")(
    lambda t: t.scored.groupBy("risk").agg(F.count("*").alias("messages")))

oracle_view("v_advice", "SELECT r.message_id, r.risk, list_filter([" + ", ".join(
    f"CASE WHEN bool_or(category = '{c}' AND severity >= 2) THEN {sql.lit(a)} END" for c, a in wording.SPECIFIC_ACTION)
    + "], lambda x: x IS NOT NULL) AS advice FROM v_risk r LEFT JOIN v_signal USING (message_id) GROUP BY ALL")
_BASE = f"{sql.array(wording.BASE_ACTION)}[risk + 1]"
oracle_view("v_action_text", f"SELECT message_id, CASE WHEN risk < 2 THEN {_BASE} "
            f"ELSE array_to_string(list_concat(advice[1:2], [{_BASE}]), ' ') END AS recommended_action FROM v_advice")
query("agg_recommended_action", "SELECT * FROM v_action_text")(lambda t: t.scored.select(
    "message_id", fusion.recommended_action(F.col("risk"), F.col("signals")).alias("recommended_action")))

oracle_view("v_note", f"""
SELECT message_id, CASE WHEN spf IS NULL AND dkim IS NULL AND dmarc IS NULL THEN {sql.lit(wording.NO_AUTH_RESULTS + ' | ')} ELSE '' END
  || CASE WHEN dmarc = 'none' THEN replace({sql.lit(wording.NO_DMARC_POLICY + ' | ')}, '{{domain}}', domain) ELSE '' END
  || CASE WHEN domain = '' THEN {sql.lit(wording.NO_SENDER + ' | ')} ELSE '' END || {sql.lit(wording.ML_MISSING)} AS uncertainties
FROM v_auth""")


@query("agg_uncertainties", "SELECT * FROM v_note")
def agg_uncertainties(t: Tables) -> DataFrame:
    notes = fusion.uncertainties(F.col("unchecked"), F.lit(None).cast("double"))
    return t.detected.select("message_id", F.array_join(notes, " | ").alias("uncertainties"))


@query("agg_reasons")
def agg_reasons(t: Tables) -> DataFrame:
    return t.scored.select("message_id", F.array_join(fusion.reasons(F.col("signals")), "\n").alias("reasons"))


query("topk_reasons_and_details", """
SELECT message_id, string_agg(category, ',' ORDER BY best) AS categories FROM (
  SELECT message_id, category, min(rn) AS best, row_number() OVER (PARTITION BY message_id ORDER BY min(rn)) AS place
  FROM v_ranked GROUP BY message_id, category) WHERE place <= 5 GROUP BY message_id""")(
    lambda t: t.detected.where(F.size("signals") > 0).select("message_id", F.array_join(F.slice(F.array_distinct(F.transform(
        fusion.in_fusion_order(F.col("signals")), lambda s: s["category"])), 1, lists.MAX_REASONS), ",").alias("categories")))


@query("agg_assessment", """
SELECT message_id, risk, score, rules_fired, uncertainties, recommended_action, coalesce(n, 0) AS signals
FROM v_risk JOIN v_note USING (message_id) JOIN v_action_text USING (message_id)
LEFT JOIN (SELECT message_id, count(*) AS n FROM v_signal GROUP BY message_id) USING (message_id)""")
def agg_assessment(t: Tables) -> DataFrame:
    return fusion.assess(t.detected).select(
        "message_id", "risk", "score", F.array_join("rules_fired", "; ").alias("rules_fired"),
        F.array_join("uncertainties", " | ").alias("uncertainties"), "recommended_action",
        F.size("signals").cast("bigint").alias("signals"),
    )


query("win_first_match", "SELECT message_id, arg_min(host, pos) AS host FROM v_linkfact WHERE host <> '' AND reg NOT IN "
      "(SELECT f.reg FROM v_fact f WHERE f.message_id = v_linkfact.message_id) GROUP BY message_id")(
    lambda t: rules.facts(t.messages).select("message_id", F.explode(F.slice(F.filter(
        "links", lambda l: l["reg"] != F.col("reg")), 1, 1)).alias("l")).select("message_id", "l.host"))
query("win_topmost_header", "SELECT message_id, hop_ip AS ip FROM v_message")(
    lambda t: t.messages.select("message_id", F.get(rules.received_ips(F.col("headers")), F.lit(0)).alias("ip")))
query("fn_auth_results", "SELECT message_id, spf, dkim, dmarc FROM v_auth")(
    lambda t: t.messages.select("message_id", *[mailauth.verdict(F.col("headers"), m).alias(m) for m in mailauth.MECHANISMS]))
query("join_lookalike_targets", "SELECT DISTINCT host FROM v_lookalike")(
    lambda t: t.message_links.select(url_fn.host(F.col("url")).alias("host")).union(
        t.messages.select(F.rtrim(dom.domain_of(F.col("sender")), F.lit(".")))).where("host <> ''").distinct()
    .where(rules.lookalike_of(F.col("host")).isNotNull()))
query("join_blocklist", f"SELECT link_id, d AS listed FROM (SELECT link_id, {sql.host('url')} AS host FROM v_url), "
      f"(SELECT unnest({sql.array(lists.BLOCKLIST_DOMAINS)}) AS d) WHERE host = d OR ends_with(host, '.' || d)")(
    lambda t: t.links.select("link_id", F.explode(dom.suffixes(url_fn.host(F.col("url")))).alias("value")).join(
        rules.blocklist(t.spark).where("kind = 'domain'"), "value").groupBy("link_id").agg(
        F.max_by("value", F.length("value")).alias("listed")))
