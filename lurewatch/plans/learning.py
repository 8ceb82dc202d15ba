"""Queries on the labelled corpus, metrics, raw mail files, prompts, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch.functions import text as txt
from lurewatch.operators import classifier, fusion, metrics, rules
from lurewatch.operators import incidents as inc
from lurewatch.plans import sql
from lurewatch.plans.registry import oracle_view, query
from lurewatch.plans.response import typed_incidents
from lurewatch.session import cut_lineage, shared_folder
from lurewatch.sources import mailfiles, records
from lurewatch.sources.keyed import KeyedTable, newest
from lurewatch.sources.tables import Tables

# --- corpus ---------------------------------------------------------------------------------------
oracle_view("v_clean", "SELECT doc_id, m.text, l.label, l.source FROM v_labelled l JOIN v_masked m USING (doc_id) WHERE length(m.text) > 20")
oracle_view("v_ready", "SELECT min(doc_id) AS doc_id, min(label) AS label FROM v_clean GROUP BY text HAVING min(label) = max(label)")


def corpus(t: Tables) -> DataFrame:
    return t.labelled.select(F.col("doc_id").alias("key"), "text", "source", "label")


query("ml_prepare", "SELECT doc_id, label FROM v_ready")(lambda t: classifier.prepare(corpus(t)).select(F.col("key").alias("doc_id"), "label"))
query("agg_conflicting_labels", "SELECT md5(text) AS text, count(*) AS copies FROM v_clean GROUP BY text HAVING count(DISTINCT label) > 1")(
    lambda t: corpus(t).withColumn("text", txt.masked(F.col("text"))).where(F.length("text") > 20).groupBy("text").agg(
        F.count("*").alias("copies"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select(F.md5("text").alias("text"), "copies"))
query("set_dedup_texts", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM v_masked WHERE length(text) > 20 GROUP BY text")(
    lambda t: t.read("documents").withColumn("text", txt.masked(F.col("text"))).where(F.length("text") > 20).groupBy(F.sha2("text", 256)).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies"))
query("agg_source_label_counts", "SELECT source, count(*) FILTER (label = 0) AS legit, count(*) FILTER (label = 1) AS phishing FROM v_labelled GROUP BY source")(
    lambda t: t.labelled.groupBy("source").pivot("label", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "legit", "1": "phishing"}))
@query("src_labelled_corpora", """
SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) FILTER (label = 1) AS phishing, count(*) FILTER (doc_id % 40 = 7) AS rejected FROM (
  SELECT source, doc_id, CASE WHEN doc_id % 40 <> 7 THEN text END AS text, CASE WHEN doc_id % 40 <> 7 THEN label END AS label FROM v_labelled) GROUP BY source""")
def src_labelled_corpora(t: Tables) -> DataFrame:
    """A folder of CSV files for each corpus; the source is the folder's name, and rows whose label is no number are rejects."""
    folder = f"{shared_folder(t.spark)}/corpora-{uuid.uuid4().hex}"
    label = F.when(F.col("doc_id") % 40 == 7, "none").otherwise(F.col("label").cast("string"))
    t.labelled.select("doc_id", "text", label.alias("label"), F.col("source").alias("corpus")).write.partitionBy("corpus").option("header", "true").option(
        "escape", '"').option("quoteAll", "true").csv(folder)
    rows = records.read_corpora(t.spark, folder, "doc_id long, text string, label int")
    whole = F.col(records.CORRUPT).isNull()
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.when(whole, F.length("text"))).alias("chars"), F.count_if(whole & (F.col("label") == 1)).alias("phishing"), F.count_if(~whole).alias("rejected"))


query("ml_split_random", "SELECT doc_id, ('0x' || md5(CAST(doc_id AS VARCHAR))[:4])::INT % 5 = 0 AS test FROM labels")(
    lambda t: t.labelled.select("doc_id", ((F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 5) == 0).alias("test")))

# A deterministic score per labelled document, so that the metrics can be restated in SQL.
_SCORE = "((doc_id * 37 + label * 41) % 101) / 101.0"
oracle_view("v_scored", f"SELECT doc_id, label, CAST({_SCORE} AS DOUBLE) AS score FROM v_labelled")


def scored(t: Tables) -> DataFrame:
    return t.labelled.select("doc_id", "label", (((F.col("doc_id") * 37 + F.col("label") * 41) % 101) / F.lit(101.0)).alias("score"))


query("agg_confusion", "SELECT count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, "
      "count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM v_scored")(lambda t: metrics.confusion(scored(t)))
query("agg_roc_auc", """SELECT round((sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * n), 9) AS roc_auc FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM v_scored),
  (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM v_scored) GROUP BY p, n""")(
    lambda t: metrics.roc_auc(scored(t)).select(F.round("roc_auc", 9).alias("roc_auc")))
query("agg_pr_auc", """SELECT round(sum(pos / p * tp / (tp + fp)), 9) AS pr_auc FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p
  FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM v_scored GROUP BY score))""")(
    lambda t: metrics.average_precision(scored(t)).select(F.round("pr_auc", 9).alias("pr_auc")))
query("agg_ece", "SELECT round(sum(abs(p - y) * n) / sum(n), 9) AS ece FROM (SELECT count(*) AS n, avg(score) AS p, avg(label) AS y FROM v_scored GROUP BY least(floor(score * 15), 14))")(
    lambda t: metrics.ece(scored(t)).select(F.round("ece", 9).alias("ece")))
query("agg_unsure_share", "SELECT round(avg(CASE WHEN score > 0.1 AND score < 0.9 THEN 1.0 ELSE 0.0 END), 9) AS share FROM v_scored")(
    lambda t: scored(t).agg(F.round(F.avg(F.when((F.col("score") > 0.1) & (F.col("score") < 0.9), 1.0).otherwise(0.0)), 9).alias("share")))
query("ml_demo_eval", "SELECT label, count(*) FILTER ((score >= 0.5) = (label = 1)) AS correct, count(*) AS n FROM v_scored GROUP BY label")(
    lambda t: scored(t).groupBy("label").agg(F.count_if((F.col("score") >= 0.5) == (F.col("label") == 1)).alias("correct"), F.count("*").alias("n")))
GRID = [round(0.25 + 0.25 * i, 2) for i in range(40)]
query("ml_temperature", f"""SELECT arg_min(t, (round(loss, 12), t)) AS temperature FROM (SELECT t, avg(greatest(z, 0) + ln(1 + exp(-abs(z))) - label * z) AS loss
  FROM (SELECT label, t, ln((score + 0.01) / (1.01 - score)) / t AS z FROM v_scored, (SELECT unnest({sql.array(GRID)}::DOUBLE[]) AS t)) GROUP BY t)""")(
    lambda t: metrics.temperature(scored(t).select("label", F.log((F.col("score") + 0.01) / (1.01 - F.col("score"))).alias("logit")), GRID))
query("agg_system_vs_model", """
SELECT risk >= 1 AS flagged, (m.message_id * 37 % 101) / 101.0 >= 0.5 AS model, count(*) AS n FROM v_risk m GROUP BY ALL""")(
    lambda t: t.scored.groupBy((F.col("risk") >= 1).alias("flagged"), (((F.col("message_id") * 37) % 101) / 101.0 >= 0.5).alias("model")).agg(F.count("*").alias("n")))

_models: dict[tuple, tuple[classifier.Model, DataFrame]] = {}


def trained(t: Tables) -> tuple[classifier.Model, DataFrame]:
    """The classifier, and the counted terms of the corpus that it learned from."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _models:
        counting, counted = classifier.term_counts(classifier.prepare(corpus(t)), bits=14)
        _models[key] = classifier.train_on(counting, counted), counted
    return _models[key]


def model(t: Tables) -> classifier.Model:
    return trained(t)[0]


def mail_scores(t: Tables) -> DataFrame:
    texts = t.messages.select("message_id", txt.masked(txt.mail_text(F.col("subject"), F.col("body_text"))).alias("text"))
    return classifier.predict(model(t), texts).select("message_id", "score")


query("ml_features")(lambda t: classifier.with_grams(classifier.prepare(corpus(t))).select("key", F.size("words").alias("words"), F.size("chars").alias("chars")))
query("ml_train")(lambda t: classifier.predict_counted(*trained(t)).select("key", "label", F.round("score", 4).alias("score")))
query("ml_predict")(lambda t: mail_scores(t))
query("sig_ml_text")(lambda t: mail_scores(t).select("message_id", fusion.ml_signal(F.col("score"), True).alias("s")).where("s is not null").select("message_id", "s.*"))


@query("ml_leave_one_source_out")
def ml_leave_one_source_out(t: Tables) -> DataFrame:
    """Sources held out in turn; a source is eligible when it has both classes. The two with most texts are used, as the
    reference evaluation names two."""
    ready = classifier.prepare(corpus(t)).cache()
    both = ready.groupBy("source").agg(F.countDistinct("label").alias("c"), F.count("*").alias("n")).where("c = 2")
    chosen = [r["source"] for r in both.orderBy(F.desc("n"), "source").limit(2).collect()]  # two names
    out = None
    for source in chosen:
        fitted = classifier.train(ready.where(F.col("source") != source), bits=14)
        part = metrics.roc_auc(classifier.predict(fitted, ready.where(F.col("source") == source))).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part)
    return out


# --- raw mail ---------------------------------------------------------------------------------------
def parsed(t: Tables) -> DataFrame:
    return mailfiles.parse(mailfiles.as_eml(t.messages)).withColumn("message_id", F.col("id").cast("bigint"))


_URLS = "(SELECT message_id, string_agg(url, ' ' ORDER BY url) AS urls FROM (SELECT message_id, url FROM v_link UNION SELECT message_id, url FROM v_textlink) GROUP BY ALL)"
_KEY = "'eml-' || sha256('<' || message_id || '@mail>|user' || recipient_id || '@" + lists.ORG_DOMAIN + "')[:16]"
_sorted_urls = lambda: F.array_join(F.array_sort(F.array_distinct(F.transform("urls", lambda l: l["url"]))), " ")
query("udtf_parse_eml", f"""
SELECT message_id, subject, sender, 'user' || recipient_id || '@{lists.ORG_DOMAIN}' AS recipients, CAST(epoch(received_at) AS BIGINT) AS received, {_KEY} AS key, coalesce(urls, '') AS urls
FROM v_message LEFT JOIN {_URLS} USING (message_id)""")(
    lambda t: parsed(t).where("error is null").select(
        "message_id", "subject", "sender", F.array_join("recipients", ",").alias("recipients"), F.unix_timestamp("received_at").alias("received"),
        F.col("message_key").alias("key"), _sorted_urls().alias("urls")))
#: Every fiftieth file is no mail.
_BROKEN = "message_id % 50 = 49"


@query("src_eml_files", f"""
SELECT message_id, CASE WHEN {_BROKEN} THEN 'not a mail' ELSE 'mail' END AS outcome, CASE WHEN NOT {_BROKEN} THEN {_KEY} END AS key,
  CASE WHEN NOT {_BROKEN} THEN coalesce(urls, '') END AS urls, CASE WHEN NOT {_BROKEN} THEN CAST(length(body_text) AS BIGINT) END AS n,
  CASE WHEN NOT {_BROKEN} THEN risk END AS risk, CASE WHEN NOT {_BROKEN} THEN score END AS score
FROM v_message LEFT JOIN {_URLS} USING (message_id) JOIN (SELECT message_id, CAST(risk AS INTEGER) AS risk, CAST(score AS INTEGER) AS score FROM v_risk) USING (message_id)""")
def src_eml_files(t: Tables) -> DataFrame:
    """File to assessment: tasks write a file for each mail, the files are read and parsed, the rules run on what was parsed. Files that
    are no mails are the rejects."""
    folder = f"{shared_folder(t.spark)}/mail-{uuid.uuid4().hex}"
    files = mailfiles.as_eml(t.messages)
    mailfiles.write_eml(files.withColumn("content", F.when(F.col("id").cast("bigint") % 50 == 49, F.encode(F.lit("just some text"), "UTF-8")).otherwise(F.col("content"))), folder)
    with mailfiles.many_files(t.spark):
        read = cut_lineage(mailfiles.read_eml(t.spark, folder, "*.txt").withColumn("message_id", F.regexp_extract("id", "id=([0-9]+)", 1).cast("bigint")))
    mails = mailfiles.as_messages(read, t.employees).withColumn("message_id", F.regexp_extract("id", "id=([0-9]+)", 1).cast("bigint"))
    assessed = fusion.fuse(rules.detected(mails, t.employees, rules.blocklist(t.spark))).select(
        "message_id", F.col("risk").cast("int").alias("risk"), F.col("score").cast("int").alias("score"))
    about = mails.select("message_id", F.col("message_key").alias("key"), _sorted_urls().alias("urls"), F.length("body_text").cast("bigint").alias("n"))
    return read.select("message_id", F.coalesce("error", F.lit("mail")).alias("outcome")).join(about, "message_id", "left").join(assessed, "message_id", "left").select(
        "message_id", "outcome", "key", "urls", "n", "risk", "score")


query("parse_headers", """
SELECT message_id, string_agg(name || ': ' || value, chr(10) ORDER BY name, value) AS headers FROM (
  SELECT message_id, unnest([{'name': 'Authentication-Results', 'value': auth},
    {'name': 'Authentication-Results', 'value': CASE WHEN auth IS NOT NULL THEN 'relay.test; spf=pass; dkim=pass; dmarc=pass' END},
    {'name': 'Message-ID', 'value': '<' || message_id || '@mail>'}, {'name': 'Received', 'value': 'from relay ([' || hop_ip || ']) by mx'},
    {'name': 'Received', 'value': 'from far ([192.0.2.66]) by relay'}, {'name': 'Reply-To', 'value': reply_to}, {'name': 'Return-Path', 'value': return_path},
    {'name': 'Subject', 'value': subject}], recursive := TRUE) FROM v_message) WHERE value IS NOT NULL GROUP BY message_id""")(
    lambda t: parsed(t).select("message_id", F.array_join(F.transform(F.array_sort(F.transform(F.filter(
        "headers", lambda h: h["name"].isin("Authentication-Results", "Message-ID", "Received", "Reply-To", "Return-Path", "Subject")),
        lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))), lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n").alias("headers")))
query("parse_sender", "SELECT message_id, sender, sender_name, lower(reply_to) AS reply_to FROM v_message WHERE sender <> ''")(
    lambda t: parsed(t).where("sender <> ''").select("message_id", "sender", "sender_name", "reply_to"))
query("parse_body", "SELECT message_id, md5(body_text) AS body FROM v_message")(
    lambda t: parsed(t).select("message_id", F.md5(F.regexp_replace("body_text", "\r?\n$", "")).alias("body")))
query("parse_attachments", "SELECT message_id, filename, lower(content_type) AS content_type FROM v_message WHERE filename IS NOT NULL")(
    lambda t: parsed(t).select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.filename", "a.content_type"))
query("zip_encrypted_flag", "SELECT message_id, encrypted AND ends_with(lower(filename), '.zip') AS encrypted FROM v_message WHERE filename IS NOT NULL")(
    lambda t: parsed(t).select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.encrypted"))

# --- prompts, answers, grounding ----------------------------------------------------------------------
KINDS = ["email_scored", "link_clicked", "password_reuse", "unusual_signin", "user_report"]
oracle_view("v_kinds", "SELECT incident_id, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM v_exposure GROUP BY ALL")


def kinds(t: Tables) -> DataFrame:
    return t.exposures.groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))  # five kinds


def prompts(t: Tables) -> DataFrame:
    return typed_incidents(t).join(kinds(t), "incident_id").select(
        txt.fingerprint(F.col("type"), F.col("severity").cast("string"), F.col("kinds")).alias("fingerprint"), "type", "severity", "kinds").dropDuplicates(["fingerprint"])


oracle_view("v_prompt", "SELECT DISTINCT sha256(type || chr(31) || severity || chr(31) || kinds)[:24] AS fingerprint, type, severity, kinds FROM v_inctype JOIN v_kinds USING (incident_id)")
query("prompt_grid", "SELECT * FROM v_prompt")(prompts)
query("set_evidence_subsets", "SELECT kinds, count(*) AS n FROM v_kinds GROUP BY kinds")(lambda t: kinds(t).groupBy("kinds").agg(F.count("*").alias("n")))


@query("sink_prompt_jsonl", "SELECT * FROM v_prompt")
def sink_prompt_jsonl(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/prompts-{uuid.uuid4().hex}"
    prompts(t).write.json(path)
    return t.spark.read.schema("fingerprint string, type string, severity int, kinds string").json(path)


query("prompt_inputs")(lambda t: t.scored.select("message_id", F.array_join(fusion.reasons(F.filter("signals", lambda s: s["source"] != "ml")), "\n").alias("evidence")))
oracle_view("v_turn", f"""
SELECT a.conv_id, a.turn, a.text AS answer, u.text AS asked FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'""")
_tok = lambda x: (f"list_concat(list_transform(regexp_extract_all({x}, '(?i)\\b(?:[a-z0-9-]+\\.)+[a-z]{{2,}}\\b'), lambda d: lower(d)), "  # noqa: E731
                  f"regexp_extract_all({x}, '[0-9]+(?:[.,][0-9]+)?'))")


def turns(t: Tables) -> DataFrame:
    c = t.read("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(before, ["conv_id", "turn"])


def grounded(answer, source):
    """Every domain and number of the answer stands in the source; step numbers 1 to 9 are free."""
    allowed = F.array_union(txt.fact_tokens(source), F.array(*[F.lit(str(i)) for i in range(1, 10)]))
    return F.size(F.array_except(txt.fact_tokens(answer), allowed)) == 0


_GROUND = f"len(list_filter({_tok('answer')}, lambda x: NOT list_contains(list_concat({_tok('asked')}, ['1','2','3','4','5','6','7','8','9']), x))) = 0"
for _name in ("grounding_check", "set_fact_subset"):
    query(_name, f"SELECT conv_id, turn, {_GROUND} AS accepted FROM v_turn")(
        lambda t: turns(t).select("conv_id", "turn", grounded(F.col("answer"), F.col("asked")).alias("accepted")))
@query("src_llm_responses", """
SELECT sha256(asked)[:24] AS fingerprint, arg_max(md5(answer), (conv_id % 2, conv_id, turn)) AS answer FROM v_turn WHERE (conv_id + turn) % 7 <> 0 GROUP BY 1""")
def src_llm_responses(t: Tables) -> DataFrame:
    """Two sets of JSON-lines files, every seventh line cut short; the last whole answer by file and row wins."""
    folder = f"{shared_folder(t.spark)}/answers-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(txt.fingerprint(F.col("asked")).alias("fingerprint"), "answer"))
    cut_short = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.substring(line, 1, 40)).otherwise(line)
    for part in range(2):
        turns(t).where(F.col("conv_id") % 2 == part).orderBy("conv_id", "turn").select(cut_short.alias("value")).write.text(f"{folder}/part-{part}")
    answers = records.read_json_lines(t.spark, folder, "fingerprint string, answer string")
    return records.last_by(answers, "fingerprint", "answer").withColumn("answer", F.md5("answer"))


oracle_view("v_cache", "SELECT sha256(asked)[:24] AS fingerprint, arg_max(answer, (conv_id, turn)) AS answer, arg_max(asked, (conv_id, turn)) AS asked FROM v_turn GROUP BY 1")
_asked = lambda t: t.read("conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"), txt.fingerprint(F.col("text")).alias("fingerprint"))
_cache = lambda t: turns(t).groupBy(txt.fingerprint(F.col("asked")).alias("fingerprint")).agg(F.max_by("answer", F.struct("conv_id", "turn")).alias("answer"))
query("join_answer_cache", "SELECT conv_id, turn, answer IS NOT NULL AS cached FROM conversations c LEFT JOIN v_cache ON fingerprint = sha256(c.text)[:24] WHERE role = 'user'")(
    lambda t: _asked(t).join(_cache(t), "fingerprint", "left").select("conv_id", "turn", F.col("answer").isNotNull().alias("cached")))
# Fixed value: a valid explanation is a summary and up to four reasons of at most 300 characters each.
ANSWER_CHARS = 5 * 300
query("explanation_select", f"SELECT conv_id, turn, CASE WHEN coalesce(ok, FALSE) THEN 'llm' ELSE 'template' END AS source FROM conversations c "
      f"LEFT JOIN (SELECT fingerprint, {_GROUND} AND length(answer) <= {ANSWER_CHARS} AS ok FROM v_cache) ON fingerprint = sha256(c.text)[:24] WHERE role = 'user'")(
    lambda t: _asked(t).join(_cache(t), "fingerprint", "left").select("conv_id", "turn", F.when(
        F.coalesce(grounded(F.col("answer"), F.col("asked")) & (F.length("answer") <= ANSWER_CHARS), F.lit(False)), "llm").otherwise("template").alias("source")))
# Steps of the notification.
STEPS = ["Change your work password now, on the real company sign-in page.", "Do not approve any sign-in prompts you did not start.",
         "Do not use the link or reply to the email.", "Your administrator will follow up."]
query("notification_steps", f"""
SELECT incident_id, employee_id, CASE WHEN bool_or(kind IN ('password_reuse', 'unusual_signin')) THEN {sql.lit(chr(10).join(f'{i}. {s}' for i, s in enumerate(STEPS, 1)))}
  ELSE {sql.lit(chr(10).join(f'{i}. {s}' for i, s in enumerate(STEPS[2:], 1)))} END AS steps FROM v_exposure GROUP BY ALL""")(
    lambda t: t.exposures.groupBy("incident_id", "employee_id").agg(F.bool_or(F.col("kind").isin("password_reuse", "unusual_signin")).alias("typed")).select(
        "incident_id", "employee_id", F.array_join(F.transform(
            F.when(F.col("typed"), F.array(*map(F.lit, STEPS))).otherwise(F.array(*map(F.lit, STEPS[2:]))),
            lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n").alias("steps")))
# Whose domain a notification names, the most telling kind first.
DOMAIN_KINDS = ["password_reuse", "link_clicked", "email_scored"]
_KIND_ORDER = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(DOMAIN_KINDS)) + " END"
query("notification_domain", f"""
SELECT incident_id, employee_id, arg_min(domain, ({_KIND_ORDER}, ts, evidence_id)) AS domain FROM v_exposure
WHERE coalesce(domain, '') <> '' AND kind IN {sql.values_in(DOMAIN_KINDS)} GROUP BY ALL""")(
    lambda t: t.exposures.where((F.coalesce("domain", F.lit("")) != "") & F.col("kind").isin(DOMAIN_KINDS)).groupBy("incident_id", "employee_id").agg(
        F.min_by("domain", F.struct(F.expr(_KIND_ORDER), "ts", "evidence_id")).alias("domain")))

# --- sources and sinks ----------------------------------------------------------------------------------
def roundtrip(df: DataFrame, t: Tables, fmt: str) -> DataFrame:
    path = f"{shared_folder(t.spark)}/{fmt}-{uuid.uuid4().hex}"
    df.write.format(fmt).save(path)
    return t.spark.read.format(fmt).schema(df.schema).load(path)


query("src_mail_json", "SELECT message_id, subject, md5(body_text) AS body FROM v_message")(
    lambda t: roundtrip(t.messages.select("message_id", "subject", "body_text", "urls", "attachments"), t, "json").orderBy("message_id").select(
        "message_id", "subject", F.md5("body_text").alias("body")))
query("src_org_json", "SELECT employee_id, name, email, department FROM v_employee")(
    lambda t: roundtrip(t.employees, t, "json").select("employee_id", "name", "email", "department"))
query("sink_employee_seed", "SELECT employee_id, name, email, department FROM v_employee")(
    lambda t: roundtrip(t.employees.select("employee_id", "name", "email", "department"), t, "parquet"))
#: Every seventeenth mail names a recipient whom nobody knows.
_UNKNOWN = 10**9


@query("sink_message_upsert", f"""
SELECT message_id, recipient_id, risk, moment AS at, CAST(CASE WHEN message_id % 17 = 3 THEN NULL WHEN message_id % 2 = 0 THEN 2 ELSE message_id % 3 END AS INTEGER) AS seen,
  CASE WHEN message_id % 17 = 3 THEN 'rejected' ELSE 'stored' END AS outcome
FROM (SELECT message_id, recipient_id + CASE WHEN message_id % 17 = 3 THEN {_UNKNOWN} ELSE 0 END AS recipient_id, CAST(risk AS INTEGER) AS risk, {sql.ts('received_at')} AS moment FROM v_risk)""")
def sink_message_upsert(t: Tables) -> DataFrame:
    """Three batches of mails; half of the earlier ones come again. Known recipients are inserted or updated by message id, the others
    go to the rejects, which are keyed, too."""
    key = ["message_id"]
    schema = "message_id long, recipient_id long, risk int, at string, seen int"
    stored, rejects = (KeyedTable(t.spark, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}", schema, key, newest(key, ["seen"])) for name in ("messages", "rejects"))
    mails = t.scored.select("message_id", (F.col("recipient_id") + F.when(F.col("message_id") % 17 == 3, _UNKNOWN).otherwise(0)).alias("recipient_id"),
                            F.col("risk").cast("int").alias("risk"), F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("at"))
    people = t.employees.select(F.col("employee_id").alias("recipient_id"))
    part = F.col("message_id") % 3
    for number in range(3):
        batch = mails.where((part == number) | ((part < number) & (F.col("message_id") % 2 == 0))).withColumn("seen", F.lit(number))
        stored.apply(batch.join(people, "recipient_id", "left_semi"), number)
        rejects.apply(batch.join(people, "recipient_id", "left_anti"), number)
    refused = rejects.read().withColumn("seen", F.lit(None).cast("int")).withColumn("outcome", F.lit("rejected"))
    return stored.read().withColumn("outcome", F.lit("stored")).unionByName(refused)


query("src_approved_logins", f"SELECT evidence_id, domain IN {sql.values_in(lists.APPROVED_LOGINS)} AS approved FROM v_evidence WHERE kind = 'password_reuse'")(
    lambda t: t.evidence.where("kind = 'password_reuse'").select("evidence_id", inc.approved(F.col("domain")).alias("approved")))
query("src_reference_lists", f"SELECT link_id, {sql.reg('host')} IN {sql.values_in(lists.SHORTENERS)} AS short, {sql.reg('host')} IN {sql.values_in(rules.REAL_DOMAINS)} AS real FROM v_urlhost")(
    lambda t: _listed(t))


def _listed(t: Tables) -> DataFrame:
    from lurewatch.functions import domains as dom
    from lurewatch.functions import urls as url_fn

    site = dom.registrable(url_fn.host(F.col("url")))
    return t.links.select("link_id", site.isin(lists.SHORTENERS).alias("short"), site.isin(rules.REAL_DOMAINS).alias("real"))


def push_events(t: Tables) -> DataFrame:
    """Password events as they arrive: base64 of JSON, every eleventh one broken."""
    body = F.to_json(F.struct(F.concat(F.lit("user"), F.col("employee_id").cast("string"), F.lit("@" + lists.ORG_DOMAIN)).alias("user"), "domain"))
    return t.evidence.where("kind = 'password_reuse'").select("evidence_id", F.when(
        F.col("evidence_id") % 11 == 0, "not base64 json").otherwise(F.base64(F.encode(body, "UTF-8"))).alias("data"))


query("src_reuse_push", f"SELECT evidence_id, 'user' || employee_id || '@{lists.ORG_DOMAIN}' AS user, domain FROM v_evidence WHERE kind = 'password_reuse' AND evidence_id % 11 <> 0")(
    lambda t: push_events(t).select("evidence_id", F.from_json(F.expr("try_to_binary(data, 'base64')").cast("string"), "user string, domain string").alias("e")).where(
        "e.user is not null").select("evidence_id", "e.user", "e.domain"))
