"""Queries on campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch import wording
from lurewatch.functions import text as txt
from lurewatch.operators import campaigns
from lurewatch.plans import sql
from lurewatch.plans.registry import oracle_view, query
from lurewatch.sources.tables import Tables

_SHORT = sql.values_in(lists.CAMPAIGN_SHORTENERS)
_FREE = sql.values_in(lists.CAMPAIGN_FREEMAIL)
oracle_view("v_high", f"""
SELECT message_id, m.recipient_id, m.received_at, epoch(m.received_at)::BIGINT AS t, lower(trim(sender)) AS sender, subject, body_text,
  CASE WHEN contains(sender, '@') THEN {sql.last_labels("string_split(lower(trim(sender)), '@')[-1]", 2)} ELSE '' END AS sender_domain
FROM v_message m JOIN v_risk r USING (message_id) WHERE risk >= 2""")
oracle_view("v_mhost", f"""
SELECT DISTINCT message_id, host FROM v_link JOIN v_high USING (message_id)
WHERE host <> '' AND host NOT IN {sql.values_in(lists.APPROVED_LOGINS)} AND {sql.last_labels('host', 2)} NOT IN {_SHORT}""")
oracle_view("v_mword", """
SELECT DISTINCT message_id, array_to_string(w[i:i + 2], ' ') AS s FROM (
  SELECT message_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM (
    SELECT message_id, regexp_extract_all(regexp_replace(lower(subject || ' ' || body_text), 'https?://\\S+', ' ', 'g'), '[\\p{L}\\p{M}\\p{N}_]+') AS w
    FROM v_high) WHERE len(w) > 0)""")
oracle_view("v_mcount", "SELECT message_id, count(*) AS n FROM v_mword GROUP BY ALL")
# Frequent shingles alone never make two texts similar here, but they count; every shared shingle is counted.
oracle_view("v_sim", """
SELECT a, b, shared / (x.n + y.n - shared) AS sim FROM (
  SELECT p.message_id AS a, q.message_id AS b, count(*) AS shared FROM v_mword p JOIN v_mword q ON p.s = q.s AND p.message_id < q.message_id GROUP BY ALL)
JOIN v_mcount x ON x.message_id = a JOIN v_mcount y ON y.message_id = b WHERE shared / (x.n + y.n - shared) >= 0.5""")
oracle_view("v_edge", f"""
SELECT a.message_id AS a, b.message_id AS b FROM v_high a JOIN v_high b ON a.message_id < b.message_id AND abs(a.t - b.t) <= {lists.WINDOW_SECONDS}
WHERE (a.sender_domain = b.sender_domain AND a.sender_domain <> '' AND a.sender_domain NOT IN {_FREE})
  OR EXISTS (SELECT 1 FROM v_mhost x JOIN v_mhost y USING (host) WHERE x.message_id = a.message_id AND y.message_id = b.message_id)
  OR EXISTS (SELECT 1 FROM v_sim s WHERE s.a = a.message_id AND s.b = b.message_id AND sim >= 0.8)""")
oracle_view("v_both", "SELECT a, b FROM v_edge UNION ALL SELECT b, a FROM v_edge")
oracle_view("v_reach", "SELECT message_id AS m, message_id AS r FROM v_high UNION SELECT v_reach.m, b.b FROM v_reach JOIN v_both b ON b.a = v_reach.r")
oracle_view("v_campaign", "SELECT m AS message_id, 'camp-' || CAST(min(r) AS VARCHAR) AS campaign_id FROM v_reach GROUP BY m HAVING count(*) > 1")
oracle_view("v_member", "SELECT * FROM v_high JOIN v_campaign USING (message_id)")
oracle_view("v_msize", "SELECT campaign_id, count(*) AS n FROM v_member GROUP BY ALL")

query("campaign_features", f"""
SELECT h.message_id, sender, sender_domain, coalesce(hosts, '') AS hosts, coalesce(n, 0) AS shingles FROM v_high h
LEFT JOIN (SELECT message_id, string_agg(host, ',' ORDER BY host) AS hosts FROM v_mhost GROUP BY ALL) USING (message_id)
LEFT JOIN v_mcount USING (message_id)""")(lambda t: t.suspicious.select(
    "message_id", "sender", "sender_domain", F.array_join(F.array_sort("hosts"), ",").alias("hosts"),
    F.size("shingles").cast("bigint").alias("shingles")))

oracle_view("v_mkey", f"""
SELECT message_id, t, 'h|' || host AS key FROM v_mhost JOIN v_high USING (message_id)
UNION ALL SELECT message_id, t, 'd|' || sender_domain FROM v_high WHERE sender_domain <> '' AND sender_domain NOT IN {_FREE}""")
oracle_view("v_pair", f"""
SELECT key, first_value(message_id) OVER d AS a, message_id AS b FROM v_mkey
WINDOW d AS (PARTITION BY key, t // 86400 ORDER BY t, message_id) QUALIFY row_number() OVER d > 1
UNION ALL
SELECT key, a, b FROM (SELECT key, message_id AS a, t, lead(message_id) OVER k AS b, lead(t) OVER k AS bt FROM v_mkey
  WINDOW k AS (PARTITION BY key ORDER BY t, message_id)) WHERE bt - t <= {lists.WINDOW_SECONDS} AND bt // 86400 > t // 86400""")


def _exact_key_pairs(t: Tables) -> DataFrame:
    pairs = campaigns.linking_pairs(t.suspicious)
    return pairs.where(~F.col("key").startswith("s|"))


query("join_campaign_pairs", "SELECT * FROM v_pair")(_exact_key_pairs)


@query("campaign_pair_score", """
SELECT DISTINCT a, b, CAST(h * 2 + d * 2 + CASE WHEN sim >= 0.8 THEN 2 WHEN sim >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS score,
  array_to_string(list_filter([CASE WHEN h = 1 THEN 'same link target' END, CASE WHEN d = 1 THEN 'same sender domain' END,
    CASE WHEN sim >= 0.8 THEN 'near-identical wording' WHEN sim >= 0.5 THEN 'similar wording' END], lambda x: x IS NOT NULL), ', ') AS reasons
FROM (SELECT CASE WHEN x.t <= y.t THEN p.a ELSE p.b END AS a, CASE WHEN x.t <= y.t THEN p.b ELSE p.a END AS b, coalesce(sim, 0) AS sim,
    CASE WHEN EXISTS (SELECT 1 FROM v_mhost x JOIN v_mhost y USING (host) WHERE x.message_id = p.a AND y.message_id = p.b) THEN 1 ELSE 0 END AS h,
    CASE WHEN x.sender_domain = y.sender_domain AND x.sender_domain <> '' AND x.sender_domain NOT IN """ + _FREE + """ THEN 1 ELSE 0 END AS d
  FROM v_edge p JOIN v_high x ON x.message_id = p.a JOIN v_high y ON y.message_id = p.b
  LEFT JOIN v_sim s ON s.a = p.a AND s.b = p.b)""")
def campaign_pair_score(t: Tables) -> DataFrame:
    """All pairs that reach the score at which a mail joins a campaign, by whatever they share."""
    score, reasons = campaigns.pair_score("x", "y", known=(F.col("host"), F.col("domain"), F.col("similarity")))
    return campaigns.matching_pairs(t.suspicious).select(
        F.col("x.message_id").alias("a"), F.col("y.message_id").alias("b"), score.alias("score"), reasons.alias("reasons"))


query("campaign_similar_texts", """
SELECT count(*) AS pairs, round(sum(sim), 6) AS total FROM v_sim WHERE sim >= 0.8 AND sim < 1""")(
    lambda t: campaigns.similar_texts(campaigns.texts_of(t.suspicious)).alias("p")
    .join(t.suspicious.select(F.col("text_id").alias("a"), F.col("message_id").alias("ma")), "a")
    .join(t.suspicious.select(F.col("text_id").alias("b"), F.col("message_id").alias("mb")), "b")
    .agg(F.count("*").alias("pairs"), F.round(F.sum("similarity"), 6).alias("total")))
query("campaign_clusters", "SELECT * FROM v_campaign")(lambda t: t.campaign_of)
query("win_keep_oldest", "SELECT campaign_id, min(message_id) AS oldest, count(*) AS n FROM v_campaign GROUP BY ALL")(
    lambda t: t.campaign_of.groupBy("campaign_id").agg(F.min("message_id").alias("oldest"), F.count("*").alias("n")))

query("agg_campaign_out", f"""
SELECT campaign_id, count(*) AS messages, count(DISTINCT recipient_id) AS recipients,
  string_agg(DISTINCT department, ',' ORDER BY department) AS departments, {sql.ts('min(received_at)')} AS first_at, {sql.ts('max(received_at)')} AS last_at
FROM v_member m JOIN v_employee e ON e.employee_id = m.recipient_id GROUP BY campaign_id""")(
    lambda t: t.members.join(t.employees, F.col("recipient_id") == F.col("employee_id")).groupBy("campaign_id").agg(
        F.countDistinct("message_id").alias("messages"), F.countDistinct("recipient_id").alias("recipients"),
        F.array_join(F.array_sort(F.collect_set("department")), ",").alias("departments"),  # the six departments
        F.date_format(F.min("received_at"), "yyyy-MM-dd HH:mm:ss").alias("first_at"),
        F.date_format(F.max("received_at"), "yyyy-MM-dd HH:mm:ss").alias("last_at")))


@query("agg_campaign_name", """
SELECT campaign_id, 'Suspicious emails from ' || arg_min(sender_domain, (-n, sender_domain)) AS name
FROM (SELECT campaign_id, sender_domain, count(*) AS n FROM v_member WHERE sender_domain <> '' GROUP BY ALL) GROUP BY campaign_id""")
def agg_campaign_name(t: Tables) -> DataFrame:
    counts = t.members.where("sender_domain <> ''").groupBy("campaign_id", "sender_domain").agg(F.count("*").alias("n"))
    return counts.groupBy("campaign_id").agg(
        F.concat(F.lit(wording.CAMPAIGN_NAME), F.min_by("sender_domain", F.struct(-F.col("n"), "sender_domain"))).alias("name"))


oracle_view("v_murl", "SELECT DISTINCT campaign_id, message_id, string_split(url, '#')[1] AS url FROM v_link JOIN v_campaign USING (message_id)")
oracle_view("v_common", "SELECT campaign_id, min(url) AS url FROM (SELECT campaign_id, url FROM v_murl JOIN v_msize USING (campaign_id) "
            "GROUP BY campaign_id, url, n HAVING count(*) = n) GROUP BY campaign_id")


def _sizes(t: Tables) -> DataFrame:
    return t.campaign_of.groupBy("campaign_id").agg(F.count("*").alias("n"))


def _common_urls(t: Tables) -> DataFrame:
    counts = t.members.select("campaign_id", F.explode("links").alias("url")).groupBy("campaign_id", "url").agg(F.count("*").alias("c"))
    return counts.join(_sizes(t), "campaign_id").where("c = n").groupBy("campaign_id").agg(F.min("url").alias("url"))


query("set_intersect_urls", "SELECT * FROM v_common")(_common_urls)


oracle_view("v_hostrank", """
SELECT campaign_id, host, count(*) AS c, any_value(n) AS n, row_number() OVER (PARTITION BY campaign_id ORDER BY count(*) DESC, host) AS rn
  FROM v_mhost JOIN v_campaign USING (message_id) JOIN v_msize USING (campaign_id)
  WHERE campaign_id NOT IN (SELECT campaign_id FROM v_common) GROUP BY campaign_id, host""")


@query("agg_trait_links", """
SELECT campaign_id, CASE WHEN c = n THEN 'Same link target in all ' || n || ' messages: ' || host
  ELSE 'Link target ' || host || ' in ' || c || ' of ' || n || ' messages' END AS trait FROM v_hostrank WHERE rn <= 2 AND c * 2 >= n
UNION ALL SELECT campaign_id, 'Same link in all ' || n || ' messages: ' || url FROM v_common JOIN v_msize USING (campaign_id)""")
def agg_trait_links(t: Tables) -> DataFrame:
    sizes, common = _sizes(t), _common_urls(t)
    counts = t.members.select("campaign_id", F.explode("hosts").alias("host")).groupBy("campaign_id", "host").agg(F.count("*").alias("c"))
    counts = counts.join(common, "campaign_id", "left_anti").join(sizes, "campaign_id")
    # The two most frequent hosts as two aggregates: best, then best of the rest.
    rank = F.struct(-F.col("c"), "host")
    best = counts.groupBy("campaign_id").agg(F.min(rank).alias("best"))
    rest = counts.join(best, "campaign_id").where(F.col("host") != F.col("best.host")).groupBy("campaign_id").agg(F.min(rank).alias("best"))
    top = best.unionByName(rest).join(counts, "campaign_id").where(F.col("host") == F.col("best.host"))
    same = txt.fill(wording.TRAITS["link_host"], n=F.col("n").cast("string"), host=F.col("host"))
    most = txt.fill(wording.TRAITS["most_hosts"], n=F.col("n").cast("string"), c=F.col("c").cast("string"), host=F.col("host"))
    hosts = top.where("c * 2 >= n").select("campaign_id", F.when(F.col("c") == F.col("n"), same).otherwise(most).alias("trait"))
    urls = common.join(sizes, "campaign_id").select(
        "campaign_id", txt.fill(wording.TRAITS["link"], n=F.col("n").cast("string"), url=F.col("url")).alias("trait"))
    return hosts.unionByName(urls)


@query("agg_trait_sender", f"""
SELECT campaign_id, CASE WHEN count(DISTINCT sender) = 1 THEN 'Same sender address in all ' || count(*) || ' messages: ' || min(sender)
  ELSE 'Same sender domain in all ' || count(*) || ' messages: ' || min(sender_domain) || ' (' || count(DISTINCT sender) || ' different addresses)' END AS trait
FROM v_member GROUP BY campaign_id
HAVING count(DISTINCT sender) = 1 OR (count(DISTINCT sender_domain) = 1 AND min(sender_domain) <> '' AND min(sender_domain) NOT IN {_FREE})""")
def agg_trait_sender(t: Tables) -> DataFrame:
    sums = t.members.groupBy("campaign_id").agg(
        F.countDistinct("message_id").alias("n"), F.countDistinct("sender").alias("addresses"), F.countDistinct("sender_domain").alias("domains"),
        F.min("sender").alias("sender"), F.min("sender_domain").alias("domain"))
    n = F.col("n").cast("string")
    one = txt.fill(wording.TRAITS["sender"], n=n, sender=F.col("sender"))
    same = txt.fill(wording.TRAITS["sender_domain"], n=n, domain=F.col("domain"),
                    a=F.col("addresses").cast("string"))
    shared = (F.col("domains") == 1) & (F.col("domain") != "") & ~F.col("domain").isin(lists.CAMPAIGN_FREEMAIL)
    return sums.select("campaign_id", F.when(F.col("addresses") == 1, one).when(shared, same).alias("trait")).where("trait is not null")


query("agg_trait_wording")(lambda t: campaigns.traits_wording(t.members).where(F.col("mean") >= lists.TRAIT_WORDING).select(
    "campaign_id", txt.fill(wording.TRAITS["wording"], p=F.bround(F.col("mean") * 100, 0).cast("int").cast("string")).alias("trait")))
query("agg_trait_span", """
SELECT campaign_id, 'All delivered within ' || CASE WHEN d < 60 THEN d || ' seconds' WHEN d < 3600 THEN (d // 60) || ' minutes' ELSE (d // 3600) || ' hours' END AS trait
FROM (SELECT campaign_id, max(t) - min(t) AS d FROM v_member GROUP BY campaign_id)""")(
    lambda t: t.members.groupBy("campaign_id").agg(F.concat(
        F.lit(wording.TRAITS["span"]), txt.duration(F.max("t") - F.min("t"))).alias("trait")))
