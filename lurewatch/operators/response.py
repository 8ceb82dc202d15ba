"""Containment, checklists and recovery from the append-only action log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import domains as dom

# The steps of the one-click bundle.
BUNDLE = ["quarantine_messages", "block_sender", "block_domain", "notify_users", "revoke_sessions", "reset_credentials", "start_investigation"]


def approved_actions(actions: DataFrame, employees: DataFrame) -> DataFrame:
    """Only an admin may approve; everything else is rejected."""
    admins = employees.where("is_admin").select(F.col("employee_id").alias("approved_by"))
    return actions.join(admins, "approved_by", "left_semi")


def steps(actions: DataFrame) -> DataFrame:
    """One row per step: "contain_campaign" is the whole bundle."""
    bundle = F.array(*map(F.lit, BUNDLE))
    return actions.withColumn(
        "step", F.explode(F.when(F.col("action") == "contain_campaign", bundle).otherwise(F.array("action")))
    )


def effects(actions: DataFrame, employees: DataFrame, messages: DataFrame) -> DataFrame:
    """(action_id, at, step, target): what each approved step changes. Actions on unknown mails are dropped."""
    mail = messages.select("message_id", F.lower("sender").alias("sender"), "recipient_id")
    known = steps(approved_actions(actions, employees)).join(mail, "message_id")
    target = (
        F.when(F.col("step") == "quarantine_messages", F.col("message_id").cast("string"))
        .when(F.col("step") == "block_sender", F.col("sender"))
        .when(F.col("step") == "block_domain", dom.domain_of(F.col("sender")))
        .when(F.col("step") == "notify_users", F.col("recipient_id").cast("string"))
        .when(F.col("step") == "start_investigation", F.lit("investigation"))
        .otherwise(F.col("employee_id").cast("string"))
    )
    return known.select("action_id", "at", "step", target.alias("target")).where("target <> ''")


def cumulative(effect_rows: DataFrame) -> DataFrame:
    """(step, target, at): the union of all effects so far, each with its first time."""
    return effect_rows.groupBy("step", "target").agg(F.min("at").alias("at"))


def contained(messages: DataFrame, state: DataFrame) -> DataFrame:
    """message_id, received_at, recipient_id, quarantined, blocked (sender or domain), blocked_on_arrival.

    A blocked domain matches exactly. The state joins on its target, one side at a time.
    """
    def of(step: str, name: str) -> DataFrame:
        return state.where(F.col("step") == step).select(F.col("target").alias(name), F.col("at").alias(f"{name}_at"))

    mail = messages.select(
        "message_id", "received_at", "recipient_id", F.col("message_id").cast("string").alias("q"),
        F.lower("sender").alias("s"), dom.domain_of(F.col("sender")).alias("d"),
    )
    joined = mail.join(of("quarantine_messages", "q"), "q", "left").join(of("block_sender", "s"), "s", "left").join(
        of("block_domain", "d"), "d", "left")
    blocked_at = F.least("s_at", "d_at")
    return joined.select(
        "message_id", "received_at", "recipient_id", F.col("q_at").isNotNull().alias("quarantined"),
        blocked_at.isNotNull().alias("blocked"),
        F.coalesce(F.col("received_at") >= blocked_at, F.lit(False)).alias("blocked_on_arrival"),
    )


# Checklist templates (type, position, key, area, least severity, needs approval).
TEMPLATES = [
    ("credential_phishing", 0, "block_sender_domain", "messages", 2, True),
    ("credential_phishing", 1, "quarantine_messages", "messages", 2, True),
    ("credential_phishing", 2, "notify_users", "notifications", 2, True),
    ("credential_phishing", 3, "revoke_sessions", "account", 3, True),
    ("credential_phishing", 4, "reset_credentials", "account", 3, True),
    ("credential_phishing", 5, "review_account_activity", "investigation", 3, False),
    ("credential_phishing", 6, "write_report", "investigation", 3, False),
    ("invoice_fraud", 0, "confirm_by_phone", "investigation", 1, False),
    ("invoice_fraud", 1, "hold_payments", "investigation", 1, False),
    ("invoice_fraud", 2, "quarantine_messages", "messages", 1, True),
    ("invoice_fraud", 3, "block_sender_domain", "messages", 1, True),
    ("invoice_fraud", 4, "notify_users", "notifications", 1, True),
    ("invoice_fraud", 5, "write_report", "investigation", 1, False),
    ("malware_attachment", 0, "quarantine_messages", "messages", 1, True),
    ("malware_attachment", 1, "block_sender_domain", "messages", 1, True),
    ("malware_attachment", 2, "notify_users", "notifications", 1, True),
    ("malware_attachment", 3, "scan_devices", "investigation", 2, False),
    ("malware_attachment", 4, "write_report", "investigation", 1, False),
    ("suspicious_email", 0, "quarantine_messages", "messages", 1, True),
    ("suspicious_email", 1, "block_sender_domain", "messages", 1, True),
    ("suspicious_email", 2, "notify_users", "notifications", 1, True),
    ("suspicious_email", 3, "write_report", "investigation", 1, False),
]
TEMPLATE_SCHEMA = "type string, position int, key string, area string, min_severity int, needs_approval boolean"


def checklist_items(incidents: DataFrame) -> DataFrame:
    """incidents(incident_id, type, severity) -> the items each one's severity calls for."""
    templates = incidents.sparkSession.createDataFrame(TEMPLATES, TEMPLATE_SCHEMA)
    return incidents.join(F.broadcast(templates), "type").where(F.col("min_severity") <= F.col("severity")).select(
        "incident_id", "key", "position", "area", "needs_approval")


def checklist_state(items: DataFrame, log: DataFrame) -> DataFrame:
    """Folds the toggles of log(incident_id, key, verb, at, log_id): approved at the first approval; done by the
    last complete or re-open; completing a step before its approval is rejected and counted."""
    keys = ["incident_id", "key"]
    approvals = log.where("verb = 'approve'").groupBy(*keys).agg(F.min("at").alias("approved_at"))
    marks = log.where("verb <> 'approve'").join(items.select(*keys, "needs_approval"), keys).join(approvals, keys, "left")
    early = F.col("needs_approval") & (F.col("verb") == "complete") & ~F.coalesce(F.col("approved_at") <= F.col("at"), F.lit(False))
    folded = marks.withColumn("early", early).groupBy(*keys).agg(
        F.max(F.when(~F.col("early"), F.struct("at", "log_id", (F.col("verb") == "complete").alias("done"))))["done"].alias("done"),
        F.count_if(F.col("early")).alias("rejected"),
    )
    return items.join(approvals, keys, "left").join(folded, keys, "left").select(
        *keys, "position", "area", "needs_approval", F.col("approved_at").isNotNull().alias("approved"),
        F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
