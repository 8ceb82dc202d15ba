"""Evidence -> incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch.operators.asof import latest_before

# Severities, sentences and guidance per kind of evidence.
REPORT_SEVERITY = {"password": 3, "clicked": 2, "downloaded": 2, "other_info": 2}
DESCRIPTIONS = {
    "email_scored": "A suspicious email was delivered",
    "link_clicked": "A link in a suspicious email was clicked (possible exposure)",
    "unusual_signin": "An unusual sign-in was seen shortly after the click",
}
REPORT_DESCRIPTIONS = {
    "password": "The employee reported entering their password",
    "clicked": "The employee reported clicking a link",
    "downloaded": "The employee reported downloading an attachment",
    "other_info": "The employee reported entering other information",
}
GUIDANCE = {
    "none": ["Do not click anything in this email.", "Delete it or forward it to your admin."],
    "clicked": ["Do not enter any information on the page you opened.", "Close the page and tell your admin that you clicked.",
                "Watch for unexpected sign-in or password-reset messages."],
    "downloaded": ["Do not open the file. Leave it where it is.", "Tell your admin so the file can be checked."],
    "password": ["Change your password now, from the real company sign-in page.",
                 "Tell your admin. They can end other sessions on your account.",
                 "If you reuse this password elsewhere, change it there too."],
    "other_info": ["Tell your admin what information you entered.", "If it was a card or bank detail, contact your bank."],
}


def mapped(value: Column, table: dict) -> Column:
    """A small fixed table as an expression; null for other values."""
    out = F.lit(None)
    for key, result in table.items():
        out = F.when(value == key, result).otherwise(out)
    return out


def severity(kind: Column, interaction: Column) -> Column:
    """null: the evidence is stored but opens nothing."""
    return F.when(kind == "link_clicked", 2).when(kind.isin("password_reuse", "unusual_signin"), 3).when(
        kind == "user_report", mapped(interaction, REPORT_SEVERITY).cast("int")
    )


def describe(kind: Column, domain: Column, interaction: Column) -> Column:
    typed = F.concat(F.lit("A password was typed on an unapproved site ("), F.coalesce(F.nullif(domain, F.lit("")), F.lit("unknown domain")), F.lit(")"))
    return F.when(kind == "password_reuse", typed).when(
        kind == "user_report", F.coalesce(mapped(interaction, REPORT_DESCRIPTIONS), F.lit("The employee sent a report"))
    ).otherwise(mapped(kind, DESCRIPTIONS))


def approved(domain: Column) -> Column:
    return F.lower(F.trim(domain)).isin(lists.APPROVED_LOGINS)


def relevant(evidence: DataFrame, risk: DataFrame) -> DataFrame:
    """Drops passwords typed on approved pages and clicks in mails below MEDIUM."""
    gated = evidence.where(~((F.col("kind") == "password_reuse") & approved(F.col("domain")))).join(risk, "message_id", "left")
    return gated.where((F.col("kind") != "link_clicked") | (F.coalesce("risk", F.lit(0)) >= 1))


def route(evidence: DataFrame, risk: DataFrame, campaign_of: DataFrame, linked_mail: DataFrame) -> DataFrame:
    """Adds severity, campaign_id and incident_id.

    Evidence about a mail follows the mail's campaign. Other evidence follows the campaign whose linked
    mail reached the employee last before it. What has no campaign belongs to the employee's own incident.
    """
    opened = relevant(evidence, risk).withColumn("severity", severity(F.col("kind"), F.col("interaction_kind"))).where(
        "severity is not null"
    )
    columns = opened.columns
    about_mail = opened.where("message_id is not null").join(campaign_of, "message_id", "left")
    other = latest_before(
        opened.where("message_id is null"),
        linked_mail.select("employee_id", F.col("received_at").alias("ts"), "campaign_id"),
        ["employee_id"], "ts", "campaign_id",
    )
    both = about_mail.select(*columns, "campaign_id").unionByName(other.select(*columns, "campaign_id"))
    own = F.concat(F.lit("emp-"), F.col("employee_id").cast("string"))
    return both.withColumn("incident_id", F.concat(F.lit("inc-"), F.coalesce("campaign_id", own)))


def firsts(exposures: DataFrame) -> DataFrame:
    """Per incident its first evidence, and the first of each severity from 2."""
    at = F.struct("ts", "evidence_id")
    return exposures.groupBy("incident_id").agg(
        F.min(at).alias("first"), *[F.min(F.when(F.col("severity") >= n, at)).alias(f"first_{n}") for n in (2, 3)]
    )


def merged_firsts(parts: DataFrame) -> DataFrame:
    """Firsts of several batches, in whatever order these came, as one."""
    return parts.groupBy("incident_id").agg(*[F.min(c).alias(c) for c in ("first", "first_2", "first_3")])


def changes(exposures: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(evidence_id, incident_id, ts, severity, event): created, escalated or updated.

    An evidence row escalates when it is the first at or above its own severity. Three minimums per
    incident say that, so no incident's history is sorted in one task.
    """
    rows = exposures.join(firsts(exposures) if known is None else known, "incident_id")
    here = F.col("evidence_id")
    rises = F.when(F.col("severity") == 3, F.col("first_3.evidence_id") == here).otherwise(F.col("first_2.evidence_id") == here)
    event = F.when(F.col("first.evidence_id") == here, "incident.created").when(rises, "incident.escalated").otherwise("incident.updated")
    return rows.select("evidence_id", "incident_id", "ts", "severity", event.alias("event"))


def summaries(exposures: DataFrame) -> DataFrame:
    """One row per incident. Severity only rises, so it is the maximum."""
    return exposures.groupBy("incident_id").agg(
        F.max("severity").alias("severity"), F.countDistinct("employee_id").alias("affected"),
        F.countDistinct("evidence_id").alias("evidence"), F.min("ts").alias("created_at"), F.max("ts").alias("last_at"),
        F.count_if(F.col("source") == "automatic").alias("automatic"), F.max("campaign_id").alias("campaign_id"),
    )
