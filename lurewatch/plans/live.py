"""Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.operators import fusion, rules
from lurewatch.operators import incidents as inc
from lurewatch.plans import sql
from lurewatch.plans.incidents import stamp
from lurewatch.plans.registry import query
from lurewatch.plans.response import tokens
from lurewatch.session import dealt_out
from lurewatch.sources.keyed import KeyedTable, newest
from lurewatch.sources.tables import Tables
from lurewatch.streaming import live


@query("st_score_on_delivery", "SELECT message_id, risk FROM v_risk")
def st_score_on_delivery(t: Tables) -> DataFrame:
    """Documents arrive; a batch is dealt out before it is parsed and the rules run, as in batch."""
    listed = rules.blocklist(t.spark)

    def score(batch: DataFrame) -> DataFrame:
        return fusion.fuse(rules.detected(t.messages_of(dealt_out(batch)), t.employees, listed)).select("message_id", "risk")

    return live.per_batch(t.stream("documents"), "scored", score).select("message_id", "risk")


@query("st_event_dedupe", "SELECT event_id, event_type FROM events")
def st_event_dedupe(t: Tables) -> DataFrame:
    """Replayed events are skipped by their id within the watermark."""
    replay = t.stream("events").unionByName(t.stream("events"))
    unique = replay.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", live.WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
    return live.to_table(unique.select("event_id", "event_type"), "events")


@query("st_click_stream", "SELECT evidence_id, token FROM v_evidence JOIN v_token USING (message_id) JOIN v_risk USING (message_id) WHERE kind = 'link_clicked' AND risk >= 1")
def st_click_stream(t: Tables) -> DataFrame:
    gate = t.scored.where("risk >= 1").select("message_id")
    clicks = t.evidence_of(t.stream("events")).where("kind = 'link_clicked'")
    return live.to_table(clicks.join(tokens(t), "message_id").join(gate, "message_id").select("evidence_id", "token"), "clicks")


@query("st_password_signin", """
SELECT s.evidence_id, p.evidence_id AS password_id FROM v_evidence s JOIN v_evidence p ON p.employee_id = s.employee_id AND p.ts <= s.ts AND s.ts <= p.ts + INTERVAL 24 HOUR
WHERE s.kind = 'unusual_signin' AND p.kind = 'password_reuse'""")
def st_password_signin(t: Tables) -> DataFrame:
    """Stream-stream join; the watermark and the time condition bound the state."""
    side = lambda kind, key, at: t.evidence_of(t.stream("events")).where(F.col("kind") == kind).select(
        F.col("evidence_id").alias(key), F.col("employee_id").alias(f"{key}_by"), F.col("ts").alias(at)).withWatermark(at, live.WATERMARK)
    typed, seen = side("password_reuse", "password_id", "typed_at"), side("unusual_signin", "evidence_id", "seen_at")
    both = seen.join(typed, F.expr("evidence_id_by = password_id_by AND seen_at >= typed_at AND seen_at <= typed_at + INTERVAL 24 HOURS"))
    return live.to_table(both.select("evidence_id", "password_id"), "signins")


#: Parts of the evidence, by id, in the order in which they arrive: in no order of time.
ARRIVAL = [3, 0, 4, 1, 2]
_part = lambda: F.col("evidence_id") % 5


@query("st_incident_state", f"SELECT incident_id, severity, affected, evidence, {sql.ts('created_at')} AS created_at, {sql.ts('last_at')} AS last_at FROM v_incident")
def st_incident_state(t: Tables) -> DataFrame:
    """Evidence arrives in five parts; each batch is gated and routed as in batch, and merged into the state of the incidents that it
    touches. Nothing else is written again."""
    state = live.incident_state(t.spark, "incidents")

    def step(batch: DataFrame, number: int) -> None:
        routed = inc.route(batch, t.scored.select("message_id", "risk"), t.campaign_of, t.linked_campaign_mail)
        state.apply(live.incident_parts(routed), number)

    live.arrivals(t.evidence, _part(), ARRIVAL, "evidence", step)
    return live.incident_view(state).withColumn("created_at", stamp("created_at")).withColumn("last_at", stamp("last_at"))


@query("st_upsert_view", "SELECT incident_id, arg_max(evidence_id, (ts, evidence_id)) AS latest FROM v_exposure GROUP BY incident_id")
def st_upsert_view(t: Tables) -> DataFrame:
    """The latest evidence of each incident, inserted or updated by key as it arrives."""
    key = ["incident_id"]
    latest = KeyedTable(t.spark, live.new_folder(t.spark, "latest"), "incident_id string, ts timestamp, evidence_id long", key, newest(key, ["ts", "evidence_id"]))
    live.arrivals(t.exposures.select("incident_id", "ts", "evidence_id"), _part(), ARRIVAL, "exposures", latest.apply)
    return latest.read().select("incident_id", F.col("evidence_id").alias("latest"))


@query("st_late_link", "SELECT evidence_id, campaign_id FROM v_evidence JOIN v_campaign USING (message_id) WHERE kind = 'link_clicked'")
def st_late_link(t: Tables) -> DataFrame:
    """Clicks are kept as they come; the view meets them with the campaigns known when it is read, so a click
    that came before its campaign is found too."""
    clicks = live.to_table(t.evidence_of(t.stream("events")).where("kind = 'link_clicked'").select("evidence_id", "message_id"), "late")
    return clicks.join(t.campaign_of, "message_id").select("evidence_id", "campaign_id")


@query("st_change_feed", f"""
SELECT CASE WHEN was IS NULL THEN 'incident.created' WHEN severity > was THEN 'incident.escalated' ELSE 'incident.updated' END AS event, incident_id, batch
FROM (SELECT *, max(severity) OVER (PARTITION BY incident_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM (
  SELECT incident_id, CAST(list_position({ARRIVAL}, evidence_id % 5) - 1 AS BIGINT) AS batch, max(severity) AS severity FROM v_exposure GROUP BY ALL))""")
def st_change_feed(t: Tables) -> DataFrame:
    """Events leave with the batch that causes them: what it changes against the state before. They are written under the number of the
    batch, before the state moves on, so a repeated batch gives the same events again in the same place."""
    state, feed = live.incident_state(t.spark, "feed-state"), live.new_folder(t.spark, "feed")

    def step(batch: DataFrame, number: int) -> None:
        live.changed_incidents(batch, state.before(number)).write.mode("overwrite").parquet(f"{feed}/batch={number}")
        state.apply(live.incident_parts(batch), number)

    live.arrivals(t.exposures, _part(), ARRIVAL, "exposures", step)
    return t.spark.read.parquet(feed).select("event", "incident_id", F.col("batch").cast("long").alias("batch"))


@query("st_campaign_incremental", "SELECT * FROM v_campaign")
def st_campaign_incremental(t: Tables) -> DataFrame:
    """Mail of each half arrives in turn; the second meets only the last 24 hours of the first."""
    middle = 1704067200 + 2 * 86400
    first, second = t.suspicious.where(F.col("t") < middle), t.suspicious.where(F.col("t") >= middle)
    labels = live.grow_campaigns(None, None, first)
    return live.grow_campaigns(labels, first, second)
