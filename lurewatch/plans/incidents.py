"""Queries on evidence and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch.functions import text as txt
from lurewatch.operators import incidents as inc
from lurewatch.operators.asof import latest_before
from lurewatch.plans import sql
from lurewatch.plans.registry import oracle_view, query
from lurewatch.sources.tables import Tables

_TS = "yyyy-MM-dd HH:mm:ss"
MEDIUM = lists.SEVERITY_NAMES.index("MEDIUM")
stamp = lambda c: F.date_format(c, _TS)
_APPROVED = sql.values_in(lists.APPROVED_LOGINS)
_REPORT = "CASE interaction_kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in inc.REPORT_SEVERITY.items()) + " END"
_SEV = f"CAST(CASE kind WHEN 'link_clicked' THEN 2 WHEN 'password_reuse' THEN 3 WHEN 'unusual_signin' THEN 3 WHEN 'user_report' THEN {_REPORT} END AS INTEGER)"
oracle_view("v_exposure0", f"""
SELECT e.*, {_SEV} AS severity, c.campaign_id AS mail_campaign FROM v_evidence e LEFT JOIN v_risk r USING (message_id) LEFT JOIN v_campaign c USING (message_id)
WHERE {_SEV} IS NOT NULL AND NOT (kind = 'password_reuse' AND domain IN {_APPROVED}) AND (kind <> 'link_clicked' OR coalesce(risk, 0) >= 1)""")
oracle_view("v_linkedmail", "SELECT recipient_id AS employee_id, received_at, campaign_id FROM v_member WHERE message_id IN (SELECT message_id FROM v_link)")
oracle_view("v_exposure", """
SELECT *, 'inc-' || coalesce(campaign_id, 'emp-' || CAST(employee_id AS VARCHAR)) AS incident_id FROM (
  SELECT e.*, mail_campaign AS campaign_id FROM v_exposure0 e WHERE message_id IS NOT NULL
  UNION ALL
  SELECT e.*, l.campaign_id FROM (SELECT * FROM v_exposure0 WHERE message_id IS NULL) e
  ASOF LEFT JOIN (SELECT employee_id, received_at, max(campaign_id) AS campaign_id FROM v_linkedmail GROUP BY ALL) l
    ON l.employee_id = e.employee_id AND l.received_at <= e.ts)""")

query("evidence_severity", f"SELECT evidence_id, {_SEV} AS severity FROM v_evidence")(
    lambda t: t.evidence.select("evidence_id", inc.severity(F.col("kind"), F.col("interaction_kind")).alias("severity")))
_DESC = ("CASE WHEN kind = 'password_reuse' THEN 'A password was typed on an unapproved site (' || domain || ')' WHEN kind = 'user_report' THEN CASE interaction_kind "
         + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in inc.REPORT_DESCRIPTIONS.items()) + " ELSE 'The employee sent a report' END ELSE CASE kind "
         + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in inc.DESCRIPTIONS.items()) + " END END")
query("evidence_describe", f"SELECT evidence_id, {_DESC} AS text FROM v_evidence")(
    lambda t: t.evidence.select("evidence_id", inc.describe(F.col("kind"), F.col("domain"), F.col("interaction_kind")).alias("text")))
_GUIDE = ", ".join(f"({sql.lit(k)}, {i}, {sql.lit(x)})" for k, xs in inc.GUIDANCE.items() for i, x in enumerate(xs, 1))


def guidance(t: Tables) -> DataFrame:
    rows = [(k, i, x) for k, xs in inc.GUIDANCE.items() for i, x in enumerate(xs, 1)]
    return t.spark.createDataFrame(rows, "interaction_kind string, line int, text string")


query("evidence_guidance", f"SELECT evidence_id, CAST(line AS INTEGER) AS line, text FROM v_evidence JOIN (VALUES {_GUIDE}) AS g(interaction_kind, line, text) USING (interaction_kind)")(
    lambda t: t.evidence.where("kind = 'user_report'").join(guidance(t), "interaction_kind").select("evidence_id", "line", "text"))
query("join_click_risk_gate", "SELECT evidence_id, risk FROM v_evidence JOIN v_risk USING (message_id) WHERE kind = 'link_clicked' AND risk >= 1")(
    lambda t: t.evidence.where("kind = 'link_clicked'").join(t.scored.select("message_id", "risk"), "message_id").where("risk >= 1").select("evidence_id", "risk"))
query("join_reuse_anti_approved", f"SELECT evidence_id, email FROM v_evidence JOIN v_employee USING (employee_id) WHERE kind = 'password_reuse' AND domain NOT IN {_APPROVED}")(
    lambda t: t.evidence.where("kind = 'password_reuse'").where(~inc.approved(F.col("domain"))).join(t.employees, "employee_id").select("evidence_id", "email"))
query("join_evidence_campaign", "SELECT evidence_id, campaign_id FROM v_evidence LEFT JOIN v_campaign USING (message_id) WHERE message_id IS NOT NULL")(
    lambda t: t.evidence.where("message_id is not null").join(t.campaign_of, "message_id", "left").select("evidence_id", "campaign_id"))
query("join_evidence_latest_campaign", "SELECT evidence_id, campaign_id FROM v_exposure WHERE message_id IS NULL")(
    lambda t: t.exposures.where("message_id is null").select("evidence_id", "campaign_id"))
# Evidence and containments in one order, worked off one by one: ``book`` holds a row for each incident (k >= 0) and each routed
# evidence (k < -1), row -1 tells the step.
oracle_view("v_happening", """
SELECT row_number() OVER (ORDER BY ts, rank, id) AS i, * FROM (
  SELECT ts, 1 AS rank, evidence_id AS id, employee_id AS who, campaign_id AS camp FROM v_exposure
  UNION ALL SELECT DISTINCT acted, 0, -1, NULL, campaign_id FROM v_step JOIN v_campaign USING (message_id) WHERE step = 'quarantine_messages'
  UNION ALL SELECT DISTINCT acted, 0, -1, employee_id, NULL FROM v_step WHERE step IN ('revoke_sessions', 'reset_credentials'))""")
_BOOK = """
SELECT * FROM (WITH RECURSIVE book(k, i, root, camp, people, opened, closed) USING KEY (k) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP)
  UNION
  SELECT r.k, r.i, r.root, r.camp, r.people, r.opened, r.closed FROM (
    SELECT unnest(list_prepend({'k': CAST(-1 AS BIGINT), 'i': i, 'root': CAST(NULL AS BIGINT), 'camp': CAST(NULL AS VARCHAR), 'people': CAST([] AS BIGINT[]), 'opened': CAST(NULL AS BIGINT), 'closed': CAST(NULL AS TIMESTAMP)},
      CASE WHEN rank = 0 THEN coalesce(shut, []) ELSE [
        {'k': coalesce(hit.k, id), 'i': i, 'root': coalesce(hit.k, id), 'camp': coalesce(hit.camp, camp), 'people': list_distinct(list_append(coalesce(hit.people, CAST([] AS BIGINT[])), who)),
         'opened': coalesce(hit.opened, i), 'closed': CAST(NULL AS TIMESTAMP)},
        {'k': -2 - id, 'i': i, 'root': coalesce(hit.k, id), 'camp': CAST(NULL AS VARCHAR), 'people': CAST([] AS BIGINT[]), 'opened': CAST(NULL AS BIGINT), 'closed': CAST(NULL AS TIMESTAMP)}] END)) AS r
    FROM (SELECT h.i, h.rank, h.id, h.who, h.camp,
        coalesce(arg_min({'k': x.k, 'camp': x.camp, 'people': x.people, 'opened': x.opened}, x.opened) FILTER (x.camp = h.camp),
                 arg_max({'k': x.k, 'camp': x.camp, 'people': x.people, 'opened': x.opened}, x.opened) FILTER (h.camp IS NULL AND list_contains(x.people, h.who))) AS hit,
        list({'k': x.k, 'i': h.i, 'root': x.root, 'camp': x.camp, 'people': x.people, 'opened': x.opened, 'closed': h.ts}) FILTER (h.rank = 0 AND (x.camp = h.camp OR list_contains(x.people, h.who))) AS shut
      FROM book s JOIN v_happening h ON s.k = -1 AND h.i = s.i + 1 LEFT JOIN recurring.book x ON x.k >= 0 AND x.closed IS NULL
      GROUP BY h.i, h.rank, h.id, h.who, h.camp)))
  SELECT * FROM book)"""
oracle_view("v_book", _BOOK)
# The same, and evidence whose campaign has no open incident follows its employee.
oracle_view("v_followed", _BOOK.replace("h.camp IS NULL AND ", ""))
oracle_view("v_case", "SELECT -2 - k AS evidence_id, root FROM v_book WHERE k < -1")
query("incident_route", """
SELECT evidence_id, 'inc-' || root AS incident_id, severity, CASE WHEN closed IS NULL THEN 'open' ELSE 'contained' END AS status
FROM v_exposure JOIN (SELECT -2 - k AS evidence_id, root FROM v_followed WHERE k < -1) USING (evidence_id) JOIN (SELECT k AS root, closed FROM v_followed WHERE k >= 0) USING (root)""")(
    lambda t: t.exposures.select("evidence_id", "severity").join(t.followed.select("evidence_id", "root"), "evidence_id").join(t.followed_book.select("root", "status"), "root")
    .select("evidence_id", F.concat(F.lit("inc-"), F.col("root").cast("string")).alias("incident_id"), "severity", "status"))
query("incident_escalation", "SELECT incident_id, max(severity) AS severity FROM v_exposure GROUP BY ALL")(
    lambda t: t.exposures.groupBy("incident_id").agg(F.max("severity").alias("severity")))
oracle_view("v_change", """
SELECT evidence_id, incident_id, ts, severity, CASE WHEN before IS NULL THEN 'incident.created' WHEN severity > before THEN 'incident.escalated' ELSE 'incident.updated' END AS event
FROM (SELECT *, max(severity) OVER (PARTITION BY incident_id ORDER BY ts, evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_exposure)""")
query("win_escalation_change", "SELECT evidence_id, incident_id, event FROM v_change")(
    lambda t: inc.changes(t.exposures).select("evidence_id", "incident_id", "event"))
query("win_alert_dedupe", f"SELECT incident_id, severity, {sql.ts('min(ts)')} AS at FROM v_exposure WHERE severity >= 2 GROUP BY incident_id, severity")(
    lambda t: t.exposures.where("severity >= 2").groupBy("incident_id", "severity").agg(stamp(F.min("ts")).alias("at")))
oracle_view("v_incident", """
SELECT incident_id, max(severity) AS severity, count(DISTINCT employee_id) AS affected, count(*) AS evidence, min(ts) AS created_at, max(ts) AS last_at,
  count(*) FILTER (source = 'automatic') AS automatic, max(campaign_id) AS campaign_id FROM v_exposure GROUP BY incident_id""")
query("agg_incident", f"SELECT incident_id, severity, affected, evidence, {sql.ts('created_at')} AS created_at, {sql.ts('last_at')} AS last_at FROM v_incident")(
    lambda t: inc.summaries(t.exposures).select("incident_id", "severity", "affected", "evidence", stamp("created_at").alias("created_at"), stamp("last_at").alias("last_at")))
query("ord_incidents", f"SELECT incident_id, severity, {sql.ts('created_at')} AS created_at FROM v_incident ORDER BY severity DESC, created_at DESC")(
    lambda t: inc.summaries(t.exposures).orderBy(F.desc("severity"), F.desc("created_at")).select("incident_id", "severity", stamp("created_at").alias("created_at")))
query("incident_timeline", f"SELECT incident_id, evidence_id, {sql.ts('ts')} AS at, employee_id, {_DESC} AS text, source FROM v_exposure")(
    lambda t: t.exposures.select("incident_id", "evidence_id", stamp("ts").alias("at"), "employee_id",
                                 inc.describe(F.col("kind"), F.col("domain"), F.col("interaction_kind")).alias("text"), "source").orderBy("at", "evidence_id"))
_COMPROMISED = "(kind IN ('password_reuse', 'unusual_signin') OR interaction_kind IN ('password', 'other_info'))"
query("agg_incident_counters", f"""
SELECT incident_id, count(DISTINCT employee_id) AS affected, count(DISTINCT employee_id) FILTER (kind <> 'user_report' OR interaction_kind <> 'none') AS interacted,
  count(DISTINCT employee_id) FILTER {_COMPROMISED.replace('(', '(', 1)} AS compromised FROM v_exposure GROUP BY incident_id""")(
    lambda t: t.exposures.groupBy("incident_id").agg(
        F.countDistinct("employee_id").alias("affected"),
        F.countDistinct(F.when((F.col("kind") != "user_report") | (F.col("interaction_kind") != "none"), F.col("employee_id"))).alias("interacted"),
        F.countDistinct(F.expr(f"CASE WHEN {_COMPROMISED} THEN employee_id END")).alias("compromised")))
query("agg_incident_summary", f"""
SELECT incident_id, 'Incident, severity ' || {sql.array(lists.SEVERITY_NAMES)}[severity + 1] || '. ' || automatic || ' evidence item(s) were detected automatically and '
  || (evidence - automatic) || ' were reported by employees.' AS summary FROM v_incident""")(
    lambda t: inc.summaries(t.exposures).select("incident_id", F.concat(
        F.lit("Incident, severity "), F.get(F.array(*map(F.lit, lists.SEVERITY_NAMES)), F.col("severity")), F.lit(". "), F.col("automatic").cast("string"),
        F.lit(" evidence item(s) were detected automatically and "), (F.col("evidence") - F.col("automatic")).cast("string"),
        F.lit(" were reported by employees.")).alias("summary")))

# Sentences of the notification.
NOTE = {
    "start": "Our security system flagged a suspicious email sent to you.",
    "clicked": "We noticed that a link in that email was clicked.",
    "password": "We noticed your password was typed on a site that is not on the approved sign-in list.",
    "signin": "We also saw a sign-in to your account from an unusual location.",
    "change": "Please change your password from the real company sign-in page and tell your admin.",
    "leave": "Please do not click links in it, and delete it or forward it to your admin.",
    "end": "This is guidance based on what was detected. It does not mean your account was misused.",
}
_TOLD = "kind IN ('password_reuse', 'unusual_signin') OR interaction_kind = 'password'"


@query("agg_employee_notification", f"""
SELECT incident_id, employee_id, concat_ws(' ', {sql.lit(NOTE['start'])}, CASE WHEN bool_or(kind = 'link_clicked') THEN {sql.lit(NOTE['clicked'])} END,
  CASE WHEN bool_or(kind = 'password_reuse') THEN {sql.lit(NOTE['password'])} END, CASE WHEN bool_or(kind = 'unusual_signin') THEN {sql.lit(NOTE['signin'])} END,
  CASE WHEN bool_or(coalesce({_TOLD}, FALSE)) THEN {sql.lit(NOTE['change'])} ELSE {sql.lit(NOTE['leave'])} END, {sql.lit(NOTE['end'])}) AS text
FROM v_exposure GROUP BY incident_id, employee_id""")
def agg_employee_notification(t: Tables) -> DataFrame:
    seen = t.exposures.groupBy("incident_id", "employee_id").agg(
        F.bool_or(F.col("kind") == "link_clicked").alias("clicked"), F.bool_or(F.col("kind") == "password_reuse").alias("typed"),
        F.bool_or(F.col("kind") == "unusual_signin").alias("signin"), F.bool_or(F.expr(f"coalesce({_TOLD}, false)")).alias("told"))
    return seen.select("incident_id", "employee_id", F.concat_ws(
        " ", F.lit(NOTE["start"]), F.when(F.col("clicked"), NOTE["clicked"]), F.when(F.col("typed"), NOTE["password"]),
        F.when(F.col("signin"), NOTE["signin"]), F.when(F.col("told"), NOTE["change"]).otherwise(NOTE["leave"]), F.lit(NOTE["end"])).alias("text"))


query("agg_already_detected", """
SELECT evidence_id, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') AS detected FROM (
  SELECT r.evidence_id, e.kind AS k FROM v_evidence r LEFT JOIN (SELECT employee_id, kind, min(ts) AS first FROM v_evidence
    WHERE source = 'automatic' AND kind IN ('link_clicked', 'password_reuse', 'unusual_signin') GROUP BY ALL) e ON e.employee_id = r.employee_id AND e.first < r.ts
  WHERE r.kind = 'user_report') GROUP BY evidence_id""")(lambda t: _already(t))


def _already(t: Tables) -> DataFrame:
    """The first sighting per employee and kind is enough to know what was seen before a report."""
    auto = t.evidence.where("source = 'automatic'").groupBy("employee_id").agg(*[
        F.min(F.when(F.col("kind") == k, F.col("ts"))).alias(k) for k in ("link_clicked", "password_reuse", "unusual_signin")])
    reports = t.evidence.where("kind = 'user_report'").select("evidence_id", "employee_id", "ts")
    return reports.join(auto, "employee_id", "left").select("evidence_id", F.concat_ws(
        ",", *[F.when(F.col(k) < F.col("ts"), k) for k in ("link_clicked", "password_reuse", "unusual_signin")]).alias("detected"))


query("agg_interactions", """
SELECT message_id, count(DISTINCT employee_id) FILTER (kind = 'link_clicked') AS clicked, count(DISTINCT employee_id) FILTER (interaction_kind = 'password') AS passwords,
  count(*) FILTER (kind = 'user_report') AS reports FROM v_evidence WHERE message_id IS NOT NULL GROUP BY message_id""")(
    lambda t: t.evidence.where("message_id is not null").groupBy("message_id").agg(
        F.countDistinct(F.when(F.col("kind") == "link_clicked", F.col("employee_id"))).alias("clicked"),
        F.countDistinct(F.when(F.col("interaction_kind") == "password", F.col("employee_id"))).alias("passwords"),
        F.count_if(F.col("kind") == "user_report").alias("reports")))
query("agg_compromised_employees", f"SELECT DISTINCT employee_id FROM v_evidence WHERE {_COMPROMISED}")(
    lambda t: t.evidence.where(_COMPROMISED).select("employee_id").distinct())
_ESC = ("greatest(risk, CASE WHEN bool_or(interaction_kind IN ('password', 'other_info')) THEN 3 "
        "WHEN bool_or(kind = 'link_clicked' OR interaction_kind IN ('clicked', 'downloaded')) THEN 2 ELSE 0 END)")
oracle_view("v_raised", f"SELECT message_id, CAST({_ESC} AS INTEGER) AS risk, any_value(v_risk.risk) AS scored FROM v_risk LEFT JOIN v_evidence USING (message_id) GROUP BY message_id, v_risk.risk")


def escalated(t: Tables) -> DataFrame:
    acts = t.evidence.where("message_id is not null").groupBy("message_id").agg(F.max(
        F.when(F.col("interaction_kind").isin("password", "other_info"), 3)
        .when((F.col("kind") == "link_clicked") | F.col("interaction_kind").isin("clicked", "downloaded"), 2).otherwise(0)).alias("raised"))
    return t.scored.select("message_id", "recipient_id", "received_at", F.col("risk").alias("scored")).join(acts, "message_id", "left").withColumn(
        "risk", F.greatest("scored", F.coalesce("raised", F.lit(0))))


query("escalated_risk", "SELECT message_id, risk FROM v_raised")(lambda t: escalated(t).select("message_id", "risk"))
query("ord_flagged", "SELECT message_id, risk, CASE WHEN risk >= 2 THEN 'dangerous' ELSE 'warning' END AS level FROM v_raised WHERE scored >= 1")(
    lambda t: escalated(t).where("scored >= 1").orderBy(F.desc("risk"), F.desc("received_at")).select(
        "message_id", "risk", F.when(F.col("risk") >= 2, "dangerous").otherwise("warning").alias("level")))

# --- types, merging, invoice incidents -------------------------------------------------------------
_MONEY = "(" + "|".join(lists.MONEY_WORDS) + ")"
oracle_view("v_ctype", f"""
SELECT campaign_id, count(*) AS n, CASE WHEN bool_or(message_id IN (SELECT message_id FROM v_link)) THEN 'credential_phishing'
  WHEN bool_or(regexp_matches(lower(subject || ' ' || body_text), '{_MONEY}')) THEN 'invoice_fraud' ELSE 'suspicious_email' END AS type
FROM v_member GROUP BY campaign_id""")


def campaign_types(t: Tables) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "subject", "body_text"))
    marks = t.messages.select("message_id", (F.size("urls") > 0).alias("linked"), text.rlike(_MONEY).alias("money")).join(t.campaign_of, "message_id")
    return marks.groupBy("campaign_id").agg(F.count("*").alias("n"), F.when(F.bool_or("linked"), "credential_phishing").when(
        F.bool_or("money"), "invoice_fraud").otherwise("suspicious_email").alias("type"))


query("incident_type", "SELECT campaign_id, type FROM v_ctype")(lambda t: campaign_types(t).select("campaign_id", "type"))
query("incident_invoice", f"""
SELECT campaign_id, 'inc-' || campaign_id AS incident_id, 'invoice_fraud' AS type, CAST({MEDIUM} AS INTEGER) AS severity, n AS messages, coalesce(e, 0) AS evidence, coalesce(a, 0) AS affected
FROM v_ctype LEFT JOIN (SELECT campaign_id, count(*) AS e, count(DISTINCT employee_id) AS a FROM v_evidence JOIN v_campaign USING (message_id)
  WHERE kind = 'email_scored' GROUP BY ALL) USING (campaign_id)
WHERE type = 'invoice_fraud' AND n >= {lists.INVOICE_MIN_MESSAGES} AND campaign_id NOT IN (SELECT camp FROM v_book WHERE k >= 0 AND closed IS NULL AND camp IS NOT NULL)""")(lambda t: _invoices(t))


def _invoices(t: Tables) -> DataFrame:
    """Link-free money campaigns of some size that have no open incident get a MEDIUM one; their delivery records are its evidence."""
    large = campaign_types(t).where((F.col("type") == "invoice_fraud") & (F.col("n") >= lists.INVOICE_MIN_MESSAGES))
    delivered = t.evidence.where("kind = 'email_scored'").join(t.campaign_of, "message_id").groupBy("campaign_id").agg(
        F.count("*").alias("e"), F.countDistinct("employee_id").alias("a"))
    return large.join(t.casebook.where("status = 'open'").select("campaign_id"), "campaign_id", "left_anti").join(delivered, "campaign_id", "left").select(
        "campaign_id", F.concat(F.lit("inc-"), "campaign_id").alias("incident_id"), "type", F.lit(MEDIUM).alias("severity"),
        F.col("n").alias("messages"), F.coalesce("e", F.lit(0)).alias("evidence"), F.coalesce("a", F.lit(0)).alias("affected"))


# Priority of the incident types over signal categories.
TYPE_PRIORITY = [("Credential phishing", ["credential_request", "lookalike_domain"]), ("Invoice fraud", ["payment_change"]),
                 ("CEO fraud", ["gift_card", "colleague_impersonation"]), ("Malicious attachment", ["risky_attachment"]), ("MFA fraud", ["mfa_code_request"])]
query("incident_type_by_signal", "SELECT r.message_id, CASE " + " ".join(
    f"WHEN bool_or(category IN {sql.values_in(cs)}) THEN '{n}'" for n, cs in TYPE_PRIORITY)
    + " ELSE 'Suspicious email' END AS type FROM v_risk r LEFT JOIN v_signal USING (message_id) GROUP BY r.message_id")(
    lambda t: t.detected.select("message_id", F.coalesce(*[F.when(_any(cs), n)
                                                         for n, cs in TYPE_PRIORITY], F.lit("Suspicious email")).alias("type")))


def _any(categories: list[str]):
    return F.arrays_overlap(F.transform("signals", lambda s: s["category"]), F.array(*map(F.lit, categories)))


_BEFORE = """SELECT evidence_id, ts, 'inc-' || coalesce('msg-' || CAST(message_id AS VARCHAR), 'emp-' || CAST(employee_id AS VARCHAR)) AS early, incident_id, severity FROM v_exposure"""
query("incident_merge", f"SELECT incident_id, arg_min(early, (ts, evidence_id)) AS survivor, count(DISTINCT early) AS merged, max(severity) AS severity, count(*) AS evidence FROM ({_BEFORE}) GROUP BY incident_id")(
    lambda t: _early(t).groupBy("incident_id").agg(F.min_by("early", F.struct("ts", "evidence_id")).alias("survivor"), F.countDistinct("early").alias("merged"),
                                                   F.max("severity").alias("severity"), F.countDistinct("evidence_id").alias("evidence")))
query("join_link_incidents", """
SELECT c.campaign_id, 'inc-' || root AS incident_id FROM v_exposure e JOIN v_campaign c USING (message_id) JOIN v_case USING (evidence_id) WHERE root IN (SELECT k FROM v_book WHERE k >= 0 AND closed IS NULL)
UNION SELECT camp, 'inc-' || k FROM v_book WHERE k >= 0 AND closed IS NULL AND camp IS NOT NULL""")(lambda t: _touching(t))


def _touching(t: Tables) -> DataFrame:
    """Open incidents that touch a campaign, by evidence about its mail or as the campaign's own."""
    name = F.concat(F.lit("inc-"), F.col("root").cast("string")).alias("incident_id")
    live = t.casebook.where("status = 'open'")
    about = t.exposures.where("message_id is not null").select("evidence_id", "message_id").join(t.campaign_of, "message_id").join(
        t.cases.select("evidence_id", "root"), "evidence_id").join(live.select("root"), "root", "left_semi").select("campaign_id", name)
    return about.union(live.where("campaign_id is not null").select("campaign_id", name)).distinct()


def _early(t: Tables) -> DataFrame:
    """Incidents as they opened before the campaign was known: one per mail, else per employee."""
    own = F.concat(F.lit("emp-"), F.col("employee_id").cast("string"))
    mail = F.concat(F.lit("msg-"), F.col("message_id").cast("string"))
    return t.exposures.select("evidence_id", "ts", "incident_id", "severity", F.concat(F.lit("inc-"), F.coalesce(mail, own)).alias("early"))


query("incident_group_view", f"""
SELECT coalesce(campaign_id, CAST(message_id AS VARCHAR)) AS incident, count(*) AS events, CAST(max(CASE WHEN interaction_kind IN ('password', 'other_info') THEN 3 ELSE 2 END) AS INTEGER) AS severity
FROM v_evidence LEFT JOIN v_campaign USING (message_id) WHERE message_id IS NOT NULL AND kind IN ('link_clicked', 'user_report') AND coalesce(interaction_kind, '') <> 'none' GROUP BY 1""")(
    lambda t: t.evidence.where("message_id is not null and kind in ('link_clicked', 'user_report') and coalesce(interaction_kind, '') <> 'none'")
    .join(t.campaign_of, "message_id", "left").groupBy(F.coalesce("campaign_id", F.col("message_id").cast("string")).alias("incident")).agg(
        F.count("*").alias("events"), F.max(F.when(F.col("interaction_kind").isin("password", "other_info"), 3).otherwise(2)).alias("severity")))
query("win_campaign_forming", f"""
SELECT campaign_id, {sql.ts('received_at')} AS at FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY received_at, message_id) AS rn FROM v_member) WHERE rn = 2""")(
    lambda t: _second(t))


def _second(t: Tables) -> DataFrame:
    """The second delivery as two minimums, so a large campaign is not sorted in one task."""
    at = F.struct("received_at", "message_id")
    first = t.members.groupBy("campaign_id").agg(F.min(at).alias("first"))
    rest = t.members.join(first, "campaign_id").where(F.col("message_id") != F.col("first.message_id"))
    return rest.groupBy("campaign_id").agg(stamp(F.min(at)["received_at"]).alias("at"))


query("alert_list", """
SELECT 'campaign-forming:' || campaign_id AS key, CAST(2 AS INTEGER) AS severity FROM v_msize UNION ALL
SELECT 'event:' || evidence_id, CAST(CASE WHEN """ + _COMPROMISED + """ THEN 3 ELSE 2 END AS INTEGER) FROM v_evidence LEFT JOIN v_risk USING (message_id)
WHERE (kind = 'link_clicked' AND risk >= 1) OR kind IN ('password_reuse', 'unusual_signin') OR (kind = 'user_report' AND interaction_kind <> 'none')""")(
    lambda t: t.campaign_of.select(F.concat(F.lit("campaign-forming:"), "campaign_id").alias("key"), F.lit(2).alias("severity")).distinct().unionByName(
        t.evidence.join(t.scored.select("message_id", "risk"), "message_id", "left").where(
            "(kind = 'link_clicked' AND risk >= 1) OR kind IN ('password_reuse', 'unusual_signin') OR (kind = 'user_report' AND interaction_kind <> 'none')")
        .select(F.concat(F.lit("event:"), F.col("evidence_id").cast("string")).alias("key"), F.expr(f"CASE WHEN {_COMPROMISED} THEN 3 ELSE 2 END").alias("severity"))))
query("join_signin_after_password", """
SELECT s.evidence_id, max(p.evidence_id) AS password_id FROM v_evidence s JOIN v_evidence p ON p.employee_id = s.employee_id AND p.ts <= s.ts AND s.ts <= p.ts + INTERVAL 1 DAY
WHERE s.kind = 'unusual_signin' AND p.kind = 'password_reuse' GROUP BY s.evidence_id""")(lambda t: _signins(t, 86400))


def _signins(t: Tables, seconds: int) -> DataFrame:
    """Sign-ins within some seconds of a password entry. Both sides meet on (employee, time bucket), the
    entry also in the next bucket, so only close rows are compared."""
    bucket = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    entries = t.evidence.where("kind = 'password_reuse'").select(
        F.col("evidence_id").alias("password_id"), "employee_id", F.col("ts").alias("typed_at"),
        F.explode(F.array(bucket("ts"), bucket("ts") + 1)).alias("bucket"))
    signins = t.evidence.where("kind = 'unusual_signin'").select("evidence_id", "employee_id", "ts", bucket("ts").alias("bucket"))
    close = signins.join(entries, ["employee_id", "bucket"]).where(
        (F.col("typed_at") <= F.col("ts")) & (F.col("ts") <= F.col("typed_at") + F.expr(f"INTERVAL {seconds} SECONDS")))
    return close.groupBy("evidence_id").agg(F.max("password_id").alias("password_id"))


query("join_password_last_click", """
SELECT p.evidence_id, c.message_id FROM (SELECT * FROM v_evidence WHERE kind = 'password_reuse') p ASOF LEFT JOIN
  (SELECT employee_id, ts, max(message_id) AS message_id FROM v_evidence WHERE kind = 'link_clicked' GROUP BY ALL) c ON c.employee_id = p.employee_id AND c.ts <= p.ts""")(
    lambda t: latest_before(t.evidence.where("kind = 'password_reuse'").select("evidence_id", "employee_id", "ts"),
                            t.evidence.where("kind = 'link_clicked'").select("employee_id", "ts", "message_id"), ["employee_id"], "ts", "message_id")
    .select("evidence_id", "message_id"))
query("ord_people_rank", """
SELECT employee_id, name, CAST(max(CASE WHEN kind = 'password_reuse' OR interaction_kind IN ('password', 'other_info') THEN 3 WHEN kind = 'link_clicked' THEN 2
  WHEN kind = 'user_report' AND interaction_kind <> 'none' THEN 1 ELSE 0 END) AS INTEGER) AS rank FROM v_evidence JOIN v_employee USING (employee_id) GROUP BY ALL""")(
    lambda t: t.evidence.join(t.employees, "employee_id").groupBy("employee_id", "name").agg(F.max(F.expr(
        "CASE WHEN kind = 'password_reuse' OR interaction_kind IN ('password', 'other_info') THEN 3 WHEN kind = 'link_clicked' THEN 2 "
        "WHEN kind = 'user_report' AND interaction_kind <> 'none' THEN 1 ELSE 0 END")).alias("rank")).orderBy(F.desc("rank"), "name"))
query("st_events_as_of", f"SELECT evidence_id, {sql.ts('ts')} AS at FROM v_evidence WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'")(
    lambda t: t.evidence.where(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp")).orderBy("ts", "evidence_id").select("evidence_id", stamp("ts").alias("at")))
