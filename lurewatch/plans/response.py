"""Queries on containment, checklists, dashboards, the organisation graph and link tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch.functions import domains as dom
from lurewatch.functions import text as txt
from lurewatch.functions import urls as url_fn
from lurewatch.operators import graph
from lurewatch.operators import incidents as inc
from lurewatch.operators import response as res
from lurewatch.plans import sql
from lurewatch.plans.incidents import _COMPROMISED, campaign_types, escalated, stamp
from lurewatch.plans.registry import oracle_view, query
from lurewatch.session import partitions
from lurewatch.sources.tables import Tables

# --- containment ----------------------------------------------------------------------------------
oracle_view("v_step", f"""
SELECT a.*, unnest(CASE WHEN action = 'contain_campaign' THEN {sql.array(res.BUNDLE)} ELSE [action] END) AS step
FROM v_action a JOIN v_employee e ON e.employee_id = a.approved_by WHERE is_admin""")
oracle_view("v_effect", f"""
SELECT * FROM (SELECT action_id, acted, step, CASE step WHEN 'quarantine_messages' THEN CAST(s.message_id AS VARCHAR) WHEN 'block_sender' THEN lower(sender)
  WHEN 'block_domain' THEN {sql.domain('sender')} WHEN 'notify_users' THEN CAST(recipient_id AS VARCHAR) WHEN 'start_investigation' THEN 'investigation'
  ELSE CAST(employee_id AS VARCHAR) END AS target FROM v_step s JOIN v_message USING (message_id)) WHERE target <> ''""")
oracle_view("v_state", "SELECT step, target, min(acted) AS acted FROM v_effect GROUP BY ALL")
oracle_view("v_contained", f"""
SELECT message_id, received_at, recipient_id, coalesce(quarantined, FALSE) AS quarantined, blocked_at IS NOT NULL AS blocked, coalesce(received_at >= blocked_at, FALSE) AS blocked_on_arrival
FROM (SELECT m.message_id, received_at, recipient_id, q.target IS NOT NULL AS quarantined, least(s.acted, d.acted) AS blocked_at FROM v_message m
  LEFT JOIN v_state q ON q.step = 'quarantine_messages' AND q.target = CAST(m.message_id AS VARCHAR)
  LEFT JOIN v_state s ON s.step = 'block_sender' AND s.target = lower(m.sender)
  LEFT JOIN v_state d ON d.step = 'block_domain' AND d.target = {sql.domain('m.sender')})""")


def effects(t: Tables) -> DataFrame:
    return res.effects(t.actions, t.employees, t.messages)


def state(t: Tables) -> DataFrame:
    return res.cumulative(effects(t))


def contained(t: Tables) -> DataFrame:
    return res.contained(t.messages, state(t))


query("containment_bundle", "SELECT action_id, step FROM v_step WHERE action = 'contain_campaign'")(
    lambda t: res.steps(res.approved_actions(t.actions, t.employees)).where("action = 'contain_campaign'").select("action_id", "step"))
query("containment_apply", "SELECT step, count(DISTINCT target) AS affected, count(*) AS actions FROM v_effect GROUP BY step")(
    lambda t: effects(t).groupBy("step").agg(F.countDistinct("target").alias("affected"), F.countDistinct("action_id").alias("actions")))
query("set_effects_union", f"SELECT step, target, {sql.ts('acted')} AS at FROM v_state")(lambda t: state(t).select("step", "target", stamp("at").alias("at")))
query("join_message_is_contained", "SELECT message_id, quarantined OR blocked AS contained FROM v_contained")(
    lambda t: contained(t).select("message_id", (F.col("quarantined") | F.col("blocked")).alias("contained")))
query("join_blocked_on_arrival", "SELECT message_id, blocked_on_arrival FROM v_contained")(lambda t: contained(t).select("message_id", "blocked_on_arrival"))
query("join_link_is_blocked", "SELECT message_id, pos, quarantined OR blocked OR host IN (SELECT target FROM v_state WHERE step = 'block_domain') AS blocked "
      "FROM v_link JOIN v_contained USING (message_id)")(
    lambda t: t.message_links.withColumn("target", url_fn.host(F.col("url"))).join(contained(t), "message_id").join(
        state(t).where("step = 'block_domain'").select("target", F.lit(True).alias("listed")), "target", "left").select(
        "message_id", "pos", (F.col("quarantined") | F.col("blocked") | F.coalesce("listed", F.lit(False))).alias("blocked")))
query("inbox_view", f"SELECT recipient_id, message_id, {sql.ts('received_at')} AS at FROM v_contained WHERE NOT quarantined AND NOT blocked_on_arrival")(
    lambda t: contained(t).where("not quarantined and not blocked_on_arrival").orderBy("recipient_id", F.desc("received_at")).select(
        "recipient_id", "message_id", stamp("received_at").alias("at")))
query("inbox_removed_count", "SELECT recipient_id, count(*) FILTER (quarantined OR blocked_on_arrival) AS removed FROM v_contained GROUP BY ALL")(
    lambda t: contained(t).groupBy("recipient_id").agg(F.count_if(F.col("quarantined") | F.col("blocked_on_arrival")).alias("removed")))
_NOW = "TIMESTAMP '2024-01-03 00:00:00'"
query("delivery_due", f"SELECT count(*) FILTER (received_at <= {_NOW}) AS due, {sql.ts(f'min(received_at) FILTER (received_at > {_NOW})')} AS next_at FROM v_message")(
    lambda t: t.messages.select("received_at").agg(F.count_if(F.expr(f"received_at <= {_NOW}")).alias("due"), stamp(F.min(F.expr(
        f"CASE WHEN received_at > {_NOW} THEN received_at END"))).alias("next_at")))
oracle_view("v_cview", f"""
SELECT c.campaign_id, count(DISTINCT m.message_id) AS delivered, count(DISTINCT m.recipient_id) AS recipients, bool_and(quarantined OR blocked_on_arrival) AS contained,
  count(DISTINCT e.employee_id) FILTER (kind = 'link_clicked') AS clickers, {sql.ts('min(received_at)')} AS first_at, {sql.ts('max(received_at)')} AS last_at
FROM v_campaign c JOIN v_contained m USING (message_id) LEFT JOIN v_evidence e USING (message_id) GROUP BY c.campaign_id""")


def campaign_view(t: Tables) -> DataFrame:
    """Counters per campaign; clicks are counted before they meet the mails, so no row is multiplied."""
    mails = contained(t).join(t.campaign_of, "message_id").groupBy("campaign_id").agg(
        F.countDistinct("message_id").alias("delivered"), F.countDistinct("recipient_id").alias("recipients"),
        F.bool_and(F.col("quarantined") | F.col("blocked_on_arrival")).alias("contained"),
        stamp(F.min("received_at")).alias("first_at"), stamp(F.max("received_at")).alias("last_at"))
    clicks = t.evidence.where("kind = 'link_clicked'").join(t.campaign_of, "message_id").groupBy("campaign_id").agg(
        F.countDistinct("employee_id").alias("clickers"))
    return mails.join(clicks, "campaign_id", "left").withColumn("clickers", F.coalesce("clickers", F.lit(0)))


query("agg_campaign_view", "SELECT * FROM v_cview")(campaign_view)
query("agg_campaign_status", "SELECT campaign_id, CASE WHEN contained THEN 'contained' WHEN delivered < n THEN 'forming' ELSE 'active' END AS status FROM v_cview JOIN v_msize USING (campaign_id)")(
    lambda t: campaign_view(t).join(t.campaign_of.groupBy("campaign_id").agg(F.count("*").alias("n")), "campaign_id").select(
        "campaign_id", F.when(F.col("contained"), "contained").when(F.col("delivered") < F.col("n"), "forming").otherwise("active").alias("status")))
query("agg_overview_tiles", f"""
SELECT count(*) FILTER (risk >= 2 AND scored >= 1) AS dangerous, count(*) FILTER (risk = 1) AS warnings, count(DISTINCT recipient_id) FILTER (risk >= 2 AND scored >= 1) AS reached,
  (SELECT count(DISTINCT employee_id) FROM v_evidence JOIN v_raised USING (message_id) WHERE kind = 'link_clicked' AND scored >= 1) AS exposed,
  (SELECT count(DISTINCT employee_id) FROM v_evidence WHERE {_COMPROMISED}) AS at_risk, (SELECT count(*) FROM v_cview WHERE contained) AS campaigns_contained
FROM v_raised JOIN v_message USING (message_id)""")(lambda t: _tiles(t))


def _tiles(t: Tables) -> DataFrame:
    flagged = escalated(t).where("scored >= 1")
    mails = flagged.agg(F.count_if(F.col("risk") >= 2).alias("dangerous"), F.count_if(F.col("risk") == 1).alias("warnings"),
                        F.countDistinct(F.when(F.col("risk") >= 2, F.col("recipient_id"))).alias("reached"))
    exposed = t.evidence.where("kind = 'link_clicked'").join(flagged.select("message_id"), "message_id", "left_semi").agg(F.countDistinct("employee_id").alias("exposed"))
    at_risk = t.evidence.where(_COMPROMISED).agg(F.countDistinct("employee_id").alias("at_risk"))
    done = campaign_view(t).agg(F.count_if("contained").alias("campaigns_contained"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  single rows side by side
    return one(mails).join(one(exposed), "one").join(one(at_risk), "one").join(one(done), "one").drop("one")


_PLAN = """
SELECT c.campaign_id, count(*) FILTER (NOT quarantined AND NOT blocked_on_arrival) AS messages,
  count(DISTINCT lower(sender)) FILTER (lower(sender) NOT IN (SELECT target FROM v_state WHERE step = 'block_sender')) AS senders,
  count(DISTINCT x.recipient_id) FILTER (CAST(x.recipient_id AS VARCHAR) NOT IN (SELECT target FROM v_state WHERE step = 'notify_users')) AS notify
FROM v_campaign c JOIN v_contained x USING (message_id) JOIN v_message m USING (message_id) GROUP BY c.campaign_id"""
oracle_view("v_plan", _PLAN)


def plan(t: Tables) -> DataFrame:
    now = state(t)
    done = lambda step, name: now.where(F.col("step") == step).select(F.col("target").alias(name), F.lit(True).alias(f"{name}_done"))
    mails = contained(t).join(t.campaign_of, "message_id").join(t.messages.select("message_id", F.lower("sender").alias("s")), "message_id").withColumn(
        "r", F.col("recipient_id").cast("string")).join(done("block_sender", "s"), "s", "left").join(done("notify_users", "r"), "r", "left")
    return mails.groupBy("campaign_id").agg(
        F.count_if(~F.col("quarantined") & ~F.col("blocked_on_arrival")).alias("messages"),
        F.countDistinct(F.when(F.col("s_done").isNull(), F.col("s"))).alias("senders"),
        F.countDistinct(F.when(F.col("r_done").isNull(), F.col("r"))).alias("notify"))


query("containment_plan", "SELECT * FROM v_plan")(plan)
query("containment_options", "SELECT campaign_id, messages = 0 AS quarantine_done, senders = 0 AS block_done, notify = 0 AS notify_done FROM v_plan")(
    lambda t: plan(t).select("campaign_id", (F.col("messages") == 0).alias("quarantine_done"), (F.col("senders") == 0).alias("block_done"), (F.col("notify") == 0).alias("notify_done")))
# Recovery items.
RECOVERY = [("investigation_opened", ["start_investigation"]), ("messages_quarantined", ["quarantine_messages"]),
            ("sender_blocked", ["block_sender", "block_domain"]), ("users_notified", ["notify_users"])]
query("recovery_checklist", " UNION ALL ".join(
    f"SELECT '{n}' AS item, count(*) > 0 AS done FROM v_state WHERE step IN {sql.values_in(ss)}" for n, ss in RECOVERY))(
    lambda t: state(t).agg(*[F.count_if(F.col("step").isin(ss)).alias(n) for n, ss in RECOVERY]).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("item"), (F.col(n) > 0).alias("done")) for n, _ in RECOVERY])).alias("r")).select("r.*"))
_RT = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE CAST(round_even(100.0 * {a} / {b}, 0) AS INTEGER) END"
query("agg_recovery_tracks", f"""
SELECT CASE WHEN affected = 0 THEN CASE WHEN scope > 0 THEN 100 ELSE 0 END ELSE CAST(round_even(100.0 * (revoked + reset) / (2 * affected), 0) AS INTEGER) END AS account,
  {_RT('held', 'scope')} AS messages, {_RT('told', 'reached')} AS notified FROM (SELECT
  (SELECT count(DISTINCT target) FROM v_state WHERE step IN ('revoke_sessions', 'reset_credentials', 'disable_account')) AS affected,
  (SELECT count(*) FROM v_state WHERE step = 'revoke_sessions') AS revoked, (SELECT count(*) FROM v_state WHERE step = 'reset_credentials') AS reset,
  (SELECT count(*) FROM v_contained WHERE message_id IN (SELECT message_id FROM v_campaign)) AS scope,
  (SELECT count(*) FROM v_contained WHERE message_id IN (SELECT message_id FROM v_campaign) AND (quarantined OR blocked)) AS held,
  (SELECT count(DISTINCT recipient_id) FROM v_member) AS reached,
  (SELECT count(DISTINCT recipient_id) FROM v_member WHERE CAST(recipient_id AS VARCHAR) IN (SELECT target FROM v_state WHERE step = 'notify_users')) AS told)""")(lambda t: _tracks(t))


def _tracks(t: Tables) -> DataFrame:
    now = state(t)
    accounts = now.agg(
        F.countDistinct(F.when(F.col("step").isin("revoke_sessions", "reset_credentials", "disable_account"), F.col("target"))).alias("affected"),
        F.countDistinct(F.when(F.col("step") == "revoke_sessions", F.col("target"))).alias("revoked"),
        F.countDistinct(F.when(F.col("step") == "reset_credentials", F.col("target"))).alias("reset"))
    scope = contained(t).join(t.campaign_of, "message_id", "left_semi")
    told = now.where("step = 'notify_users'").select(F.col("target").cast("bigint").alias("recipient_id"), F.lit(True).alias("told"))
    mails = scope.join(told, "recipient_id", "left").agg(
        F.countDistinct("message_id").alias("scope"), F.countDistinct(F.when(F.col("quarantined") | F.col("blocked"), F.col("message_id"))).alias("held"),
        F.countDistinct("recipient_id").alias("reached"), F.countDistinct(F.when(F.col("told"), F.col("recipient_id"))).alias("informed"))
    both = accounts.withColumn("one", F.lit(1)).join(mails.withColumn("one", F.lit(1)), "one")
    protected = F.when(F.col("affected") == 0, F.when(F.col("scope") > 0, 100).otherwise(0)).otherwise(
        txt.percent(F.col("revoked") + F.col("reset"), 2 * F.col("affected")))
    return both.select(protected.alias("account"), txt.percent(F.col("held"), F.col("scope")).alias("messages"),
                       txt.percent(F.col("informed"), F.col("reached")).alias("notified"))


query("join_contained_incidents", """
SELECT DISTINCT incident_id FROM v_exposure WHERE campaign_id IN (SELECT campaign_id FROM v_campaign JOIN v_step USING (message_id) WHERE step = 'quarantine_messages')
  OR employee_id IN (SELECT employee_id FROM v_step WHERE step IN ('revoke_sessions', 'reset_credentials'))""")(lambda t: _contained_incidents(t))


def _contained_incidents(t: Tables) -> DataFrame:
    done = res.steps(res.approved_actions(t.actions, t.employees))
    campaigns = done.where("step = 'quarantine_messages'").join(t.campaign_of, "message_id").select("campaign_id").distinct()
    people = done.where("step in ('revoke_sessions', 'reset_credentials')").select("employee_id").distinct()
    return t.exposures.join(campaigns, "campaign_id", "left_semi").select("incident_id").unionByName(
        t.exposures.join(people, "employee_id", "left_semi").select("incident_id")).distinct()


# --- checklists and dashboard ---------------------------------------------------------------------
_TEMPLATE_ROWS = ", ".join("(" + ", ".join(sql.lit(v) for v in row) + ")" for row in res.TEMPLATES)
oracle_view("v_inctype", "SELECT incident_id, severity, campaign_id, coalesce(type, 'credential_phishing') AS type FROM v_incident LEFT JOIN v_ctype USING (campaign_id)")
oracle_view("v_item", f"""
SELECT incident_id, key, CAST(position AS INTEGER) AS position, area, needs_approval FROM v_inctype JOIN (VALUES {_TEMPLATE_ROWS})
AS t(type, position, key, area, min_severity, needs_approval) USING (type) WHERE min_severity <= severity""")
# The admins' toggles of one incident's items, derived from the orders.
oracle_view("v_log", """
SELECT incident_id, key, action_id AS log_id, acted, ['approve', 'complete', 'reopen', 'complete'][CAST(action_id % 4 AS INTEGER) + 1] AS verb FROM (
  SELECT a.*, 'inc-' || campaign_id AS incident_id, ['quarantine_messages', 'write_report', 'notify_users', 'hold_payments'][CAST(a.action_id // 4 % 4 AS INTEGER) + 1] AS key
  FROM v_action a JOIN v_campaign USING (message_id))""")
oracle_view("v_toggle", """
SELECT l.*, needs_approval, (SELECT min(acted) FROM v_log x WHERE x.incident_id = l.incident_id AND x.key = l.key AND x.verb = 'approve') AS approved_at
FROM v_log l JOIN v_item USING (incident_id, key) WHERE verb <> 'approve'""")
oracle_view("v_itemstate", """
SELECT i.*, EXISTS (SELECT 1 FROM v_log x WHERE x.incident_id = i.incident_id AND x.key = i.key AND x.verb = 'approve') AS approved,
  coalesce(done, FALSE) AS done, coalesce(rejected, 0) AS rejected FROM v_item i LEFT JOIN (
  SELECT incident_id, key, count(*) FILTER (early) AS rejected, arg_max(verb = 'complete', (acted, log_id)) FILTER (NOT early) AS done
  FROM (SELECT *, needs_approval AND verb = 'complete' AND NOT coalesce(approved_at <= acted, FALSE) AS early FROM v_toggle) GROUP BY ALL) USING (incident_id, key)""")


def typed_incidents(t: Tables) -> DataFrame:
    return inc.summaries(t.exposures).join(campaign_types(t).select("campaign_id", "type"), "campaign_id", "left").select(
        "incident_id", "severity", F.coalesce("type", F.lit("credential_phishing")).alias("type"))


def toggles(t: Tables) -> DataFrame:
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    a = F.col("action_id")
    return t.actions.join(t.campaign_of, "message_id").select(
        F.concat(F.lit("inc-"), "campaign_id").alias("incident_id"),
        pick(["quarantine_messages", "write_report", "notify_users", "hold_payments"], F.floor(a / 4) % 4).alias("key"),
        a.alias("log_id"), "at", pick(["approve", "complete", "reopen", "complete"], a % 4).alias("verb"))


def item_state(t: Tables) -> DataFrame:
    return res.checklist_state(res.checklist_items(typed_incidents(t)), toggles(t))


query("checklist_templates", "SELECT incident_id, key, position, area, needs_approval FROM v_item")(lambda t: res.checklist_items(typed_incidents(t)))
query("join_checklist_missing", "SELECT incident_id, key FROM v_item WHERE (incident_id, key) NOT IN (SELECT (incident_id, key) FROM v_log)")(
    lambda t: res.checklist_items(typed_incidents(t)).select("incident_id", "key").join(toggles(t).select("incident_id", "key").distinct(), ["incident_id", "key"], "left_anti"))
query("checklist_state", "SELECT incident_id, key, approved, done, rejected FROM v_itemstate")(lambda t: item_state(t).select("incident_id", "key", "approved", "done", "rejected"))
query("win_latest_state", "SELECT incident_id, key, arg_max(verb, (acted, log_id)) AS verb FROM v_log WHERE verb <> 'approve' GROUP BY ALL")(
    lambda t: toggles(t).where("verb <> 'approve'").groupBy("incident_id", "key").agg(F.max_by("verb", F.struct("at", "log_id")).alias("verb")))
query("agg_checklist_progress", """
SELECT incident_id, coalesce(area, 'all') AS area, count(*) FILTER (done) AS done, count(*) AS total, CAST(round_even(100.0 * count(*) FILTER (done) / count(*), 0) AS INTEGER) AS percent,
  coalesce(string_agg(key, ',' ORDER BY position, key) FILTER (NOT done), '') AS remaining
FROM v_itemstate GROUP BY GROUPING SETS ((incident_id, area), (incident_id))""")(lambda t: _progress(t))


def _progress(t: Tables) -> DataFrame:
    """Areas and the whole of each incident from one aggregation; an incident has a template's items at most."""
    items, sets = item_state(t), [["incident_id", "area"], ["incident_id"]]
    open_items = F.array_sort(F.collect_list(F.when(~F.col("done"), F.struct("position", "key"))))
    sums = items.groupingSets(sets, "incident_id", "area").agg(
        F.count_if("done").alias("done"), F.count("*").alias("total"), F.array_join(F.transform(open_items, lambda x: x["key"]), ",").alias("remaining"))
    return sums.select("incident_id", F.coalesce("area", F.lit("all")).alias("area"), "done", "total", txt.percent(F.col("done"), F.col("total")).alias("percent"), "remaining")


query("agg_dashboard", """
SELECT (SELECT count(*) FROM v_incident) AS open_incidents, (SELECT count(*) FROM v_incident WHERE severity = 2) AS high, (SELECT count(*) FROM v_incident WHERE severity = 3) AS critical,
  (SELECT count(DISTINCT campaign_id) FROM v_campaign) AS campaigns, (SELECT count(DISTINCT employee_id) FROM v_exposure) AS affected,
  (SELECT count(*) FROM v_itemstate WHERE needs_approval AND NOT approved AND NOT done) AS pending, (SELECT count(*) FROM v_itemstate WHERE done) AS done,
  (SELECT count(*) FROM v_itemstate) AS total, (SELECT arg_max(incident_id, (created_at, incident_id)) FROM v_incident WHERE severity = 3) AS latest_critical""")(lambda t: _dashboard(t))


def _dashboard(t: Tables) -> DataFrame:
    one = lambda df: df.withColumn("one", F.lit(1))
    found = inc.summaries(t.exposures)
    a = found.agg(F.count("*").alias("open_incidents"), F.count_if(F.col("severity") == 2).alias("high"), F.count_if(F.col("severity") == 3).alias("critical"),
                  F.max(F.when(F.col("severity") == 3, F.struct("created_at", "incident_id")))["incident_id"].alias("latest_critical"))
    b = t.campaign_of.agg(F.countDistinct("campaign_id").alias("campaigns"))
    c = t.exposures.agg(F.countDistinct("employee_id").alias("affected"))
    d = item_state(t).agg(F.count_if(F.col("needs_approval") & ~F.col("approved") & ~F.col("done")).alias("pending"), F.count_if("done").alias("done"), F.count("*").alias("total"))
    return one(a).join(one(b), "one").join(one(c), "one").join(one(d), "one").drop("one")


oracle_view("v_feed", f"""
SELECT event, incident_id AS key, CAST(evidence_id AS VARCHAR) AS cause, ts AS moment FROM v_change
UNION ALL SELECT 'message.scored', CAST(message_id AS VARCHAR), CAST(evidence_id AS VARCHAR), ts FROM v_evidence WHERE kind = 'email_scored'
UNION ALL SELECT 'campaign.updated', campaign_id, CAST(message_id AS VARCHAR), received_at FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY received_at, message_id) AS rn FROM v_member) WHERE rn > 1
UNION ALL SELECT 'containment.done', 'inc-' || k, 'contained', closed FROM v_book WHERE k >= 0 AND closed IS NOT NULL
UNION ALL SELECT 'recovery.updated', incident_id, CAST(log_id AS VARCHAR), acted FROM v_log l JOIN v_item i USING (incident_id, key)
  WHERE NOT (verb = 'complete' AND needs_approval AND NOT coalesce((SELECT min(acted) FROM v_log x WHERE x.incident_id = l.incident_id AND x.key = l.key AND x.verb = 'approve') <= acted, FALSE))""")


@query("sink_change_feed", f"SELECT event, key, cause, {sql.ts('moment')} AS at FROM v_feed")
def sink_change_feed(t: Tables) -> DataFrame:
    """All seven kinds of feed events, one row each, with what caused it and when."""
    row = lambda event, key, cause, at: [F.lit(event).alias("event"), key.cast("string").alias("key"), cause.cast("string").alias("cause"), at.alias("at")]
    changed = inc.changes(t.exposures).select("event", F.col("incident_id").alias("key"), F.col("evidence_id").cast("string").alias("cause"), F.col("ts").alias("at"))
    scored = t.evidence.where("kind = 'email_scored'").select(*row("message.scored", F.col("message_id"), F.col("evidence_id"), F.col("ts")))
    order = F.struct("received_at", "message_id")
    first = t.members.groupBy("campaign_id").agg(F.min(order)["message_id"].alias("first"))
    joined = t.members.join(first, "campaign_id").where("message_id <> first").select(*row("campaign.updated", F.col("campaign_id"), F.col("message_id"), F.col("received_at")))
    closed = t.casebook.where("closed_at is not null").select(*row("containment.done", F.concat(F.lit("inc-"), F.col("root").cast("string")), F.lit("contained"), F.col("closed_at")))
    log = toggles(t)
    approved = log.where("verb = 'approve'").groupBy("incident_id", "key").agg(F.min("at").alias("approved_at"))
    items = res.checklist_items(typed_incidents(t)).select("incident_id", "key", "needs_approval")
    early = (F.col("verb") == "complete") & F.col("needs_approval") & ~F.coalesce(F.col("approved_at") <= F.col("at"), F.lit(False))
    acts = log.join(items, ["incident_id", "key"]).join(approved, ["incident_id", "key"], "left").where(~early)
    acts = acts.select(*row("recovery.updated", F.col("incident_id"), F.col("log_id"), F.col("at")))
    every = changed.unionByName(scored).unionByName(joined).unionByName(closed).unionByName(acts)
    return every.withColumn("at", stamp("at"))


query("set_merge_event_logs", "SELECT event_id, count(*) AS copies FROM (SELECT event_id FROM events UNION SELECT event_id FROM events) GROUP BY event_id")(
    lambda t: t.read("events").unionByName(t.read("events")).dropDuplicates(["event_id"])
    .select("event_id", F.lit(1).cast("bigint").alias("copies")))

# --- recipients, links ------------------------------------------------------------------------------
query("join_recipient", "SELECT message_id, employee_id FROM v_message JOIN v_employee ON employee_id = recipient_id")(
    lambda t: t.messages.select("message_id", F.lower(F.get("recipients", F.lit(0))).alias("email")).join(t.employees.select("email", "employee_id"), "email").select("message_id", "employee_id"))
query("join_expand_recipients", """
SELECT message_id, recipient_id AS employee_id FROM v_message WHERE kind <> 21 UNION SELECT message_id, employee_id FROM v_message JOIN v_employee ON department = 'Management' WHERE kind = 21""")(lambda t: _expanded(t))


def _expanded(t: Tables) -> DataFrame:
    """Lists are looked up by equality like single addresses: the directory holds (address, employee) rows. A list's members are dealt into
    parts, and a mail to it meets each part, so that no list is one task's; the result is as many rows as mails reach people."""
    return expanded_recipients(t.messages, t.employees)


def expanded_recipients(messages: DataFrame, employees: DataFrame) -> DataFrame:
    """(message_id, employee_id), each pair once. Both sides are made distinct before they meet, so only mails with several addresses need it after."""
    spark = messages.sparkSession
    parts = 4 * partitions(spark)
    own = employees.select("email", "employee_id", F.lit(0).alias("part"))
    lists_ = employees.where("department = 'Management'").select(
        F.lit("management@" + lists.ORG_DOMAIN).alias("email"), "employee_id", F.pmod(F.xxhash64("employee_id"), F.lit(parts)).cast("int").alias("part"))
    directory = own.unionByName(lists_).distinct()
    to = F.when(F.col("kind") == 21, "management@" + lists.ORG_DOMAIN).otherwise(F.get("recipients", F.lit(0)))
    mails = messages.select("message_id", to.alias("email")).groupBy("message_id").agg(F.collect_set("email").alias("emails"))  # a mail's own few addresses
    every = F.when(F.col("email") == "management@" + lists.ORG_DOMAIN, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))

    def reached(some: DataFrame) -> DataFrame:
        rows = some.select("message_id", F.explode("emails").alias("email")).withColumn("part", F.explode(every))
        return rows.repartition(partitions(spark), "email", "part").join(directory, ["email", "part"]).select("message_id", "employee_id")

    return reached(mails.where(F.size("emails") == 1)).unionByName(reached(mails.where(F.size("emails") > 1)).distinct())


_TOKEN = "sha256(message_id || '|' || recipient_id || '|' || url)[:22]"
oracle_view("v_token", f"SELECT v_link.message_id, recipient_id, v_link.url, {_TOKEN.replace('message_id', 'v_link.message_id').replace('|| url', '|| v_link.url')} AS token FROM v_link JOIN v_message USING (message_id)")


def tokens(t: Tables) -> DataFrame:
    """One stable token per mail, employee and link: a hash instead of a random value."""
    rows = t.messages.select("message_id", "recipient_id", F.explode(F.array_distinct(F.transform("urls", lambda u: u["url"]))).alias("url"))
    return rows.withColumn("token", track_token(F.col("url")))


def track_token(url):
    return F.substring(F.sha2(F.concat_ws("|", F.col("message_id").cast("string"), F.col("recipient_id").cast("string"), url), 256), 1, 22)


BASE_URL = "http://localhost:8000/r/"
query("track_issue", "SELECT * FROM v_token")(tokens)
query("join_click_token", "SELECT evidence_id, token FROM v_evidence JOIN v_token USING (message_id) WHERE kind = 'link_clicked'")(
    lambda t: t.evidence.where("kind = 'link_clicked'").join(tokens(t), "message_id").select("evidence_id", "token"))


def _rewrite(value, url_list):
    """Longest link first, so that a link that starts another one cannot break it."""
    pairs = F.array_sort(F.transform(url_list, lambda u: F.struct((-F.length(u)).alias("n"), u.alias("u"), track_token(u).alias("k"))))
    return F.aggregate(pairs, value, lambda acc, p: F.replace(acc, p["u"], F.concat(F.lit(BASE_URL), p["k"])))


_urls = lambda: F.array_distinct(F.transform("urls", lambda u: u["url"]))
_T1, _T2 = (_TOKEN.replace("|| url", f"|| coalesce({c}, 'none')") for c in ("url", "text_url"))
_REW = lambda x: f"replace(replace({x}, coalesce(url, 'none://'), '{BASE_URL}' || {_T1}), coalesce(text_url, 'none://'), '{BASE_URL}' || {_T2})"
query("track_rewrite_text", f"SELECT message_id, md5({_REW('body_text')}) AS body FROM v_message")(
    lambda t: t.messages.select("message_id", F.md5(_rewrite(F.col("body_text"), _urls())).alias("body")))
query("track_rewrite_html", f"SELECT message_id, replace(body_html, 'href=\"' || url || '\"', 'href=\"{BASE_URL}' || {_T1} || '\"') AS html FROM v_message WHERE url IS NOT NULL")(
    lambda t: t.messages.where("body_html is not null").select("message_id", F.aggregate(
        F.transform(_urls(), lambda u: F.struct(u.alias("u"), track_token(u).alias("k"))), F.col("body_html"),
        lambda acc, p: F.replace(acc, F.concat(F.lit('href="'), p["u"], F.lit('"')), F.concat(F.lit('href="' + BASE_URL), p["k"], F.lit('"')))).alias("html")))
query("track_inbox_rewrite", f"SELECT message_id, recipient_id, length({_REW('body_text')}) AS n FROM v_message")(
    lambda t: t.messages.select("message_id", "recipient_id", F.length(_rewrite(F.col("body_text"), _urls())).cast("bigint").alias("n")))

# --- organisation graph ---------------------------------------------------------------------------
_SERV = "(VALUES " + ", ".join("(" + ", ".join(sql.lit(v) for v in s) + ")" for s in graph.SERVICES) + ") AS s(node, label, kind, sensitivity)"
_DEPS = "(VALUES " + ", ".join("(" + ", ".join(sql.lit(v) for v in d) + ")" for d in graph.DEPENDENCIES) + ") AS d(source, target, relation)"
_ACC = "(VALUES " + ", ".join(f"('{d}', '{s}')" for d, ss in graph.ACCESS.items() for s in ss) + ") AS a(department, node)"
oracle_view("v_node0", f"SELECT * FROM {_SERV}")
oracle_view("v_dep", f"SELECT * FROM {_DEPS}")
oracle_view("v_own", f"SELECT employee_id, node FROM v_employee JOIN {_ACC} USING (department) UNION SELECT employee_id, 'idp' FROM v_employee")
oracle_view("v_reached", "SELECT * FROM v_own UNION SELECT employee_id, target FROM v_own JOIN v_dep ON source = v_own.node JOIN v_node0 n ON n.node = target WHERE n.kind = 'data'")
oracle_view("v_node", """
SELECT employee_id, n.node, CASE WHEN kind IN ('identity_provider', 'data') THEN kind ELSE 'service' END AS kind, (employee_id, n.node) IN (SELECT (employee_id, node) FROM v_reached) AS at_risk
FROM v_employee, v_node0 n UNION ALL SELECT employee_id, 'colleagues', 'people', (employee_id, 'mail') IN (SELECT (employee_id, node) FROM v_reached) FROM v_employee""")
query("blast_reach", "SELECT employee_id, node AS service_id FROM v_reached")(lambda t: graph.reach(t.employees))
query("blast_nodes", "SELECT * FROM v_node")(lambda t: graph.nodes(t.employees))
query("blast_edges", """
SELECT e.employee_id, d.source, d.target, x.at_risk AND y.at_risk AS lit FROM v_employee e, (SELECT source, target FROM v_dep UNION ALL SELECT 'mail', 'colleagues') d
JOIN v_node x ON x.employee_id = e.employee_id AND x.node = d.source JOIN v_node y ON y.employee_id = e.employee_id AND y.node = d.target""")(lambda t: graph.edges(t.employees))
query("blast_counts", """
SELECT employee_id, count(*) FILTER (at_risk AND kind = 'service') AS services, count(*) FILTER (at_risk AND kind = 'data') AS data_sets FROM v_node GROUP BY employee_id""")(
    lambda t: graph.nodes(t.employees).groupBy("employee_id").agg(
        F.count_if(F.col("at_risk") & (F.col("kind") == "service")).alias("services"), F.count_if(F.col("at_risk") & (F.col("kind") == "data")).alias("data_sets")))
query("blast_explanation", """
SELECT employee_id, 'may reach ' || string_agg(node, ', ' ORDER BY node) AS text FROM v_node WHERE at_risk AND kind = 'service' GROUP BY employee_id""")(
    lambda t: graph.nodes(t.employees).where("at_risk and kind = 'service'").groupBy("employee_id").agg(F.concat(
        F.lit("may reach "), F.array_join(F.array_sort(F.collect_list("node")), ", ")).alias("text")))
