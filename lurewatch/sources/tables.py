"""The given tables and the mail views derived from them.

Every view is a narrow projection of one table or a join on a key, so its rows grow with the tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch.functions import urls as url_fn
from lurewatch.session import cut_lineage, dealt_out
from lurewatch.sources.lures import COLUMNS, DEPARTMENTS, FIRST_NAMES, KINDS, LURES

LURE_SCHEMA = ", ".join(
    f"{name} {'int' if name == 'kind' else 'boolean' if name == 'encrypted' else 'string'}" for name in COLUMNS
)
FIRST_DELIVERY = 1704067200  # 2024-01-01 00:00:00 UTC
DELIVERY_STEP, DELIVERY_SPAN = 1800, 345600
EVIDENCE_KINDS = {
    "view": "email_scored", "click": "link_clicked", "error": "password_reuse", "signup": "unusual_signin",
    "purchase": "user_report",
}
INTERACTIONS = ["none", "clicked", "downloaded", "password", "other_info"]
ACTIONS = [
    "quarantine_messages", "block_sender", "block_domain", "notify_users", "revoke_sessions", "reset_credentials",
    "disable_account", "start_investigation", "contain_campaign",
]


def employee_name(key: Column) -> Column:
    first = F.get(F.array(*map(F.lit, FIRST_NAMES)), (key % len(FIRST_NAMES)).cast("int"))
    return F.concat(first, F.lit(" Vale"), key.cast("string"))


def employee_name_reversed(key: Column) -> Column:
    first = F.get(F.array(*map(F.lit, FIRST_NAMES)), (key % len(FIRST_NAMES)).cast("int"))
    return F.concat(F.lit("Vale"), key.cast("string"), F.lit(", "), first)


def employee_email(key: Column) -> Column:
    return F.concat(F.lit("user"), key.cast("string"), F.lit("@" + lists.ORG_DOMAIN))


class Tables:
    """Lazy views over one data folder."""

    _open: dict[tuple, "Tables"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Tables":
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream, be it one file or a folder of files: a stream takes a file only by a pattern."""
        return self.spark.readStream.schema(self.read(name).schema).parquet(f"{self.folder}/{name}.parque[t]")

    @cached_property
    def message_count(self) -> int:
        return self.read("documents").count()

    @cached_property
    def employee_count(self) -> int:
        return self.read("customer").count()

    @cached_property
    def recipient_count(self) -> int:
        """Mail goes to all employees."""
        return self.employee_count

    @cached_property
    def lures(self) -> DataFrame:
        return self.spark.createDataFrame(LURES, LURE_SCHEMA)

    @cached_property
    def employees(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("employee_id"),
            employee_name(key).alias("name"),
            employee_email(key).alias("email"),
            F.get(F.array(*map(F.lit, DEPARTMENTS)), (F.col("c_nationkey") % 6).cast("int")).alias("department"),
            F.initcap("c_mktsegment").alias("title"),
            (key % 50 == 0).alias("is_admin"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.messages_of(self.read("documents"))

    @cached_property
    def dealt_messages(self) -> DataFrame:
        """The mails, their documents dealt out first: one row group may hold all of them, and the rules are what costs."""
        return self.messages_of(dealt_out(self.read("documents")))

    def messages_of(self, documents: DataFrame) -> DataFrame:
        """One parsed mail per document. The 24 wrappers are a fixed small table, so they are broadcast."""
        doc = F.col("doc_id")
        group = F.floor(doc / 96).cast("string")
        spread = (F.floor(doc / 384) * 5 + F.floor(doc / 24) % 5).cast("string")
        colleague = (doc * 7) % self.employee_count

        def filled(name: str) -> Column:
            value = F.replace(F.col(name), F.lit("{g}"), group)
            return F.replace(value, F.lit("{p}"), spread)

        joined = documents.join(
            F.broadcast(self.lures.withColumnRenamed("kind", "lure_kind")), F.col("doc_id") % KINDS == F.col("lure_kind")
        )
        recipient = doc % self.recipient_count
        sender_name = F.replace(
            F.replace(F.col("sender_name"), F.lit("{e}"), employee_name(colleague)), F.lit("{r}"), employee_name_reversed(colleague)
        )
        base = joined.select(
            doc.alias("message_id"),
            F.col("lure_kind").alias("kind"),
            "source", "lang", "subject", "sentence", "signature", "text",
            sender_name.alias("sender_name"),
            filled("sender").alias("sender"),
            filled("reply_to").alias("reply_to"),
            filled("return_path").alias("return_path"),
            "auth", "hop_ip",
            filled("url").alias("url"), filled("anchor").alias("anchor"), filled("text_url").alias("text_url"),
            "filename", "content_type", "encrypted",
            recipient.alias("recipient_id"),
            F.timestamp_seconds(F.lit(FIRST_DELIVERY) + (doc * DELIVERY_STEP) % DELIVERY_SPAN).alias("received_at"),
        )
        space = F.lit(" ")
        body = F.concat(
            F.col("text"), F.lit("\n"), F.col("sentence"),
            F.when(F.col("url").isNotNull(), F.concat(space, F.col("url"))).otherwise(""),
            F.when(F.col("text_url").isNotNull(), F.concat(space, F.col("text_url"))).otherwise(""),
            F.lit("\n\n"), F.col("signature"),
        )
        html = F.when(
            F.col("url").isNotNull(),
            F.concat(
                F.lit("<html><head><title>mail</title></head><body><p>"), F.col("sentence"), F.lit('</p><p><a href="'),
                F.col("url"), F.lit('">'), F.col("anchor"), F.lit("</a></p></body></html>"),
            ),
        )

        def header(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("name"), value.alias("value"))

        headers = F.filter(
            F.array(
                header("Received", F.concat(F.lit("from relay ([") , F.col("hop_ip"), F.lit("]) by mx"))),
                header("Received", F.lit("from far ([192.0.2.66]) by relay")),
                header("Authentication-Results", F.col("auth")),
                header("Authentication-Results", F.when(F.col("auth").isNotNull(), "relay.test; spf=pass; dkim=pass; dmarc=pass")),
                header("Return-Path", F.col("return_path")),
                header("Message-ID", F.concat(F.lit("<"), F.col("message_id").cast("string"), F.lit("@mail>"))),
            ),
            lambda h: h["value"].isNotNull(),
        )

        def link(url: Column, anchor: Column, found_in: str) -> Column:
            return F.struct(url.alias("url"), anchor.alias("anchor_text"), F.lit(found_in).alias("found_in"))

        links = F.filter(
            F.array(
                link(F.col("url"), F.col("anchor"), "html"),
                link(F.col("text_url"), F.lit(None).cast("string"), "text"),
            ),
            lambda l: l["url"].isNotNull(),
        )
        attachments = F.when(
            F.col("filename").isNotNull(),
            F.array(F.struct(
                F.col("filename").alias("filename"), F.col("content_type").alias("content_type"),
                F.length("text").alias("size_bytes"), F.col("encrypted").alias("encrypted"),
            )),
        ).otherwise(F.array().cast("array<struct<filename:string,content_type:string,size_bytes:int,encrypted:boolean>>"))
        return base.select(
            "message_id", "kind", "source", "lang", "subject", body.alias("body_text"), html.alias("body_html"),
            "sender", "sender_name", "reply_to", "recipient_id",
            F.array(employee_email(F.col("recipient_id"))).alias("recipients"), "received_at",
            links.alias("urls"), attachments.alias("attachments"), headers.alias("headers"),
        )

    @cached_property
    def message_links(self) -> DataFrame:
        return self.messages.select(
            "message_id", F.posexplode("urls").alias("pos", "link")
        ).select("message_id", "pos", "link.url", "link.anchor_text", "link.found_in")

    @cached_property
    def links(self) -> DataFrame:
        """Links of the mails and the addresses of the given pages."""
        mail = self.message_links.select(F.concat(F.lit("m"), F.col("message_id"), F.lit("-"), F.col("pos")).alias("link_id"), "url")
        page = self.read("pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("link_id"), "url")
        return mail.unionByName(page)

    @cached_property
    def attachments(self) -> DataFrame:
        return self.messages.select("message_id", F.posexplode("attachments").alias("pos", "file")).select(
            "message_id", "pos", "file.filename", "file.content_type", "file.size_bytes", "file.encrypted"
        )

    @cached_property
    def headers(self) -> DataFrame:
        return self.messages.select("message_id", F.posexplode("headers").alias("pos", "header")).select(
            "message_id", "pos", "header.name", "header.value"
        )

    @cached_property
    def evidence(self) -> DataFrame:
        return self.evidence_of(self.read("events"))

    def evidence_of(self, events: DataFrame) -> DataFrame:
        """What was observed, one row per event."""
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in EVIDENCE_KINDS.items() for x in pair]), F.col("event_type"))
        event = F.col("event_id")
        about_mail = F.col("kind").isin("email_scored", "link_clicked", "user_report")
        approved = F.get(F.array(*map(F.lit, lists.APPROVED_LOGINS)), (event % len(lists.APPROVED_LOGINS)).cast("int"))
        typed_on = F.when(event % 5 == 0, approved).otherwise(
            F.concat(F.lit("login.micr0soft-alerts"), (event % 10).cast("string"), F.lit(".test"))
        )
        return (
            events.withColumn("kind", kind).select(
                event.alias("evidence_id"),
                "kind",
                F.col("user_id").alias("employee_id"),
                F.when(about_mail, event % self.message_count).alias("message_id"),
                F.when(F.col("kind") == "password_reuse", typed_on).alias("domain"),
                F.when(F.col("kind") == "user_report", "reported").otherwise("automatic").alias("source"),
                F.col("ts").cast("timestamp").alias("ts"),
                F.when(
                    F.col("kind") == "user_report",
                    F.get(F.array(*map(F.lit, INTERACTIONS)), (event % 5).cast("int")),
                ).alias("interaction_kind"),
            )
        )

    @cached_property
    def actions(self) -> DataFrame:
        """The admins' action log, one row per order."""
        order = F.col("o_orderkey")
        return self.read("orders").select(
            order.alias("action_id"),
            F.get(F.array(*map(F.lit, ACTIONS)), (order % 9).cast("int")).alias("action"),
            ((order * 13) % self.message_count).alias("message_id"),
            ((order * 11) % self.recipient_count).alias("employee_id"),
            (F.col("o_custkey") % self.employee_count).alias("approved_by"),
            F.timestamp_seconds(F.lit(FIRST_DELIVERY) + (order * 977) % DELIVERY_SPAN).alias("at"),
        )

    @cached_property
    def labelled(self) -> DataFrame:
        """Labelled corpus: the given labels with the text and the source of their documents."""
        return self.read("labels").join(self.read("documents"), "doc_id").select(
            "doc_id", "text", "source", F.col("toxic").alias("label"), "quality"
        )

    @cached_property
    def detected(self) -> DataFrame:
        """Signals per mail, kept in the shared folder: ids, times and signals, no bodies. Campaigns,
        incidents and dashboards start from this table, as they would on a cluster."""
        from lurewatch.operators import rules

        return cut_lineage(rules.detected(self.dealt_messages, self.employees, rules.blocklist(self.spark)))

    @cached_property
    def scored(self) -> DataFrame:
        """(message_id, recipient_id, received_at, signals, unchecked, score, risk, rules_fired)."""
        from lurewatch.operators import fusion

        return fusion.fuse(self.detected)

    @cached_property
    def suspicious(self) -> DataFrame:
        """Matching features of the mails at HIGH or above; the others are never clustered."""
        from lurewatch.operators import campaigns

        high = self.scored.where("risk >= 2").select("message_id")
        return cut_lineage(campaigns.features(self.messages.join(high, "message_id", "left_semi")))

    @cached_property
    def campaign_of(self) -> DataFrame:
        """(message_id, campaign_id), kept in the shared folder."""
        from lurewatch.operators import campaigns

        return cut_lineage(campaigns.clusters(self.suspicious))

    @cached_property
    def members(self) -> DataFrame:
        return self.suspicious.join(self.campaign_of, "message_id")

    @cached_property
    def exposures(self) -> DataFrame:
        """Evidence that opens or raises an incident, routed. Kept in the shared folder."""
        from lurewatch.operators import incidents

        routed = incidents.route(
            self.evidence, self.scored.select("message_id", "risk"), self.campaign_of, self.linked_campaign_mail
        )
        return cut_lineage(routed)

    @cached_property
    def closings(self) -> tuple[DataFrame, DataFrame]:
        """When approved containments close incidents: by campaign and by employee."""
        from lurewatch.operators import casebook, response

        return casebook.containments(response.steps(response.approved_actions(self.actions, self.employees)), self.campaign_of)

    @cached_property
    def cases(self) -> DataFrame:
        """Each exposure with the evidence that opened its incident, containments considered. Kept in the shared folder."""
        from lurewatch.operators import casebook

        return casebook.route(self.exposures, *self.closings)

    @cached_property
    def casebook(self) -> DataFrame:
        """One row per incident, with its status. Kept in the shared folder."""
        from lurewatch.operators import casebook

        return cut_lineage(casebook.book(self.exposures, self.cases, *self.closings))

    @cached_property
    def followed(self) -> DataFrame:
        """As ``cases``; evidence whose campaign has no open incident follows its employee. Kept in the shared folder."""
        from lurewatch.operators import casebook

        return casebook.route(self.exposures, *self.closings, follow=True)

    @cached_property
    def followed_book(self) -> DataFrame:
        """One row per incident of ``followed``, with its status. Kept in the shared folder."""
        from lurewatch.operators import casebook

        return cut_lineage(casebook.book(self.exposures, self.followed, *self.closings))

    @cached_property
    def linked_campaign_mail(self) -> DataFrame:
        """(employee_id, received_at, message_id, campaign_id) of campaign mails that carry a link."""
        return self.members.where(F.size("links") > 0).select(
            F.col("recipient_id").alias("employee_id"), "received_at", "message_id", "campaign_id"
        )

    def hosts_of(self, links: DataFrame) -> DataFrame:
        return links.withColumn("host", url_fn.host(F.col("url")))
