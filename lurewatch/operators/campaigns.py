"""Campaigns: which risky mails belong together.

A pair of mails within 24 hours is linked by a shared link host, a shared sender domain or near-identical
wording (Jaccard >= 0.8); a campaign is a connected component of at least two mails. Pairs are never
listed for this. All mails of one host on one day are linked with each other, and two days of a host are
linked exactly when the last mail of the first and the first of the second are within 24 hours, so per
(key, day) the earliest and latest time are enough. They are aggregates that combine map-side, so a host
that holds a third of all mails is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch.functions import domains as dom
from lurewatch.functions import text as txt
from lurewatch.functions import urls as url_fn
from lurewatch.operators.components import connected_components
from lurewatch.session import bounded, cut_lineage, partitions

DAY = 86400
#: One text in so many tells which shingles are frequent, and so many of these are kept. Both only choose an order of comparison.
SAMPLED, FREQUENT = 8, 200_000
#: Prefixes, then pairs, are worked off in so many slices, and a slice's shuffle files go before the next. A shingle is in one slice.
SLICES = 4
#: Parts into which the shingles of a campaign are dealt, and the mails of a key.
PARTS = 16


def features(messages: DataFrame) -> DataFrame:
    """What matching compares, one row per mail. Shingles are 64-bit hashes of their words."""
    hosts = F.array_distinct(F.filter(
        F.transform("urls", lambda u: url_fn.host(u["url"])),
        lambda h: (h != "") & ~h.isin(lists.APPROVED_LOGINS) & ~dom.registered_domain(h).isin(lists.CAMPAIGN_SHORTENERS),
    ))
    sender = F.lower(F.trim("sender"))
    shingles = txt.shingles(F.concat_ws(" ", "subject", "body_text"))
    return messages.select(
        "message_id", "recipient_id", "received_at", F.unix_timestamp("received_at").alias("t"), sender.alias("sender"),
        F.when(sender.contains("@"), dom.registered_domain(F.substring_index(sender, "@", -1))).otherwise("").alias("sender_domain"),
        hosts.alias("hosts"),
        F.array_distinct(F.transform("urls", lambda u: F.substring_index(u["url"], "#", 1))).alias("links"),
        shingles.alias("shingles"),
    ).withColumn("text_id", F.when(F.size("shingles") > 0, F.sha2(F.array_join(F.array_sort("shingles"), "\n"), 256))).withColumn(
        "shingles", F.transform("shingles", lambda s: F.xxhash64(s)))


def _keys() -> Column:
    """The values on which two mails can meet exactly: hosts, the sender's domain, the text."""
    return F.filter(
        F.concat(
            F.transform("hosts", lambda h: F.concat(F.lit("h|"), h)),
            F.array(
                F.when((F.col("sender_domain") != "") & ~F.col("sender_domain").isin(lists.CAMPAIGN_FREEMAIL),
                       F.concat(F.lit("d|"), F.col("sender_domain"))),
                F.concat(F.lit("s|"), F.col("text_id")),
            ),
        ),
        lambda k: k.isNotNull(),
    )


def match_keys(feats: DataFrame) -> DataFrame:
    """(message_id, t, key): the values on which two mails can meet exactly."""
    return feats.select("message_id", "t", F.explode(_keys()).alias("key")).withColumn("day", F.floor(F.col("t") / DAY))


def segments(keys: DataFrame, window: int = lists.WINDOW_SECONDS) -> DataFrame:
    """(key, day, segment, first, last): runs of days of one key whose mails form one chain.

    The window function runs over days of a key, not over mails.
    """
    days = keys.groupBy("key", "day").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    order = Window.partitionBy("key").orderBy("day")
    starts = F.when(F.col("first") - F.lag("last").over(order) <= window, None).otherwise(F.col("day"))
    return days.withColumn("start", starts).withColumn(
        "segment", F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("start")


def _frequent(texts: DataFrame) -> np.ndarray:
    """The most frequent shingles of a sample of the texts, rarest first; a bounded list."""
    sample = texts.where(F.pmod(F.xxhash64("text_id"), F.lit(SAMPLED)) == 0).select(F.explode("shingles").alias("w"))
    found = sample.groupBy("w").agg(F.count("*").alias("df")).where("df > 2").orderBy(F.desc("df"), "w").limit(FREQUENT)
    rows = sorted(cut_lineage(found).collect(), key=lambda r: (-r["df"], r["w"]))
    return np.array([r["w"] for r in rows][::-1], dtype=np.int64)


def _prefixes(hashed: DataFrame, frequent: np.ndarray, threshold: float, part: int) -> DataFrame:
    """(id, n, w, at): the first n - ceil(threshold * n) + 1 shingles of each text, in one order for all texts; of these a slice."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]
    told = np.zeros(1 << 22, bool)  # by the first 22 bits, which shingles can be frequent at all
    told[values.view(np.uint64) >> np.uint64(42)] = True

    def ranks(words: np.ndarray) -> np.ndarray:
        found, open_ = np.zeros(len(words), np.int64), np.flatnonzero(told[words.view(np.uint64) >> np.uint64(42)])
        if len(open_):
            place = np.minimum(np.searchsorted(values, words[open_]), len(values) - 1)
            found[open_] = np.where(values[place] == words[open_], by_value[place] + 1, 0)
        return found

    def ordered(words: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        """By owner, rank and word, as one number of which 37 bits are the word's first; should these decide nothing, by the whole words."""
        plain, rank = words.view(np.uint64), ranks(words)
        if rows <= 1 << 9 and len(values) < 1 << 18:
            short = (owner << 18 | rank).astype(np.uint64) << np.uint64(37) | plain >> np.uint64(27)
            order = np.argsort(short)
            short = short[order]
            if not (short[1:] == short[:-1]).any():
                return order
        return np.lexsort((plain, rank, owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            words, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            words, ends = words.astype(np.int64, copy=False), ends - ends[0]
            size = np.diff(ends)
            owner = np.repeat(np.arange(len(size)), size)
            order = ordered(words, owner, len(size))
            at = np.arange(len(words)) - ends[owner]
            words = words[order]
            keep = (at < (size - np.ceil(size * threshold).astype(np.int64) + 1)[owner]) & (words % SLICES == part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner[keep])), pa.array(size[owner[keep]].astype(np.int32)),
                 pa.array(words[keep]), pa.array(at[keep].astype(np.int32))], names=["id", "n", "w", "at"])

    return hashed.mapInArrow(run, "id long, n int, w long, at int")


def _met(keys: DataFrame, threshold: float) -> DataFrame:
    """(a, b, x, y, shared, i, j): texts of sizes x and y that share keys, how many, and the last places of these in both."""
    a, b = keys.alias("a"), keys.alias("b")
    fits = (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("b.n") >= F.col("a.n") * threshold)
    return a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id")) & fits).groupBy(
        F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).agg(
        F.count("*").alias("shared"), F.max("a.at").alias("i"), F.max("b.at").alias("j"))


def similar_texts(texts: DataFrame, threshold: float = lists.NEAR_IDENTICAL) -> DataFrame:
    """Pairs (a, b, similarity) of different texts with Jaccard >= threshold, exactly.

    ``texts``: (text_id, shingles); rows of one text count once, behind the exchange of the prefixes. Prefix
    filter: with all shingles in one order, two texts can only reach the threshold when they share one of
    their first n - ceil(threshold * n) + 1. Any order does; shingles that a sample shows to be frequent come
    last, so boilerplate is hardly ever a join key. Lengths must fit too, and so must the shared prefix: up to the
    last shared place both texts are counted, behind it only what is left of the shorter rest can be shared.
    Prefixes are taken map-side: only they are shuffled, slice by slice, and whole texts only for the pairs that are left.
    """
    bounded(texts.sparkSession)
    hashed = texts.where(F.size("shingles") > 0).select("text_id", F.transform("shingles", lambda s: F.xxhash64(s)).alias("shingles"))
    key = F.xxhash64("text_id")  # two texts with one key only make more pairs to compare
    hashed, frequent = hashed.select(key.alias("id"), "shingles"), _frequent(hashed)
    slices = [_prefixes(hashed, frequent, threshold, part).repartition("w").dropDuplicates(["w", "id", "n", "at"]) for part in range(SLICES)]
    met = reduce(DataFrame.union, [cut_lineage(_met(keys, threshold)) for keys in slices]).groupBy("a", "b", "x", "y").agg(
        F.sum("shared").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"))
    needed = (F.col("x") + F.col("y")) * (threshold / (1 + threshold)) - 1e-6
    behind = F.least(F.col("x") - F.col("i"), F.col("y") - F.col("j")) - 1
    prefix = lambda n: n - F.ceil(n * threshold) + 1
    unread = F.greatest(F.col("x") - prefix(F.col("x")), F.col("y") - prefix(F.col("y")))
    # A table, so its size is known before any text moves: as long as Spark can broadcast the keys, only wanted texts are shuffled.
    pairs = cut_lineage(met.where(F.col("shared") + F.least(behind, unread) >= needed).select("a", "b"))
    wanted = cut_lineage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    whole = texts.select(key.alias("key"), "text_id", "shingles").join(wanted, "key", "left_semi").repartition("key").dropDuplicates(["key", "text_id"])
    left, right = (whole.select(F.col("key").alias(k), F.col("text_id").alias(i), F.col("shingles").alias(w)) for k, i, w in (("a", "p", "x"), ("b", "q", "y")))
    # A text moves with each of its pairs, so pairs are confirmed in slices too.
    parts = [pairs.where(F.pmod("a", F.lit(SLICES)) == part).join(left, "a").join(right, "b") for part in range(SLICES)]
    return reduce(DataFrame.union, [cut_lineage(part.select(
        F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), txt.jaccard(F.col("x"), F.col("y")).alias("similarity")).where(
        F.col("similarity") >= threshold)) for part in parts])


def texts_of(feats: DataFrame) -> DataFrame:
    return feats.where("text_id is not null").select("text_id", "shingles")


def clusters(feats: DataFrame, window: int = lists.WINDOW_SECONDS) -> DataFrame:
    """(message_id, campaign_id) for every mail in a campaign. The id names the smallest mail id."""
    keys = match_keys(feats)
    segs = segments(keys, window)
    node = F.concat_ws("|", "key", "segment")
    member = keys.join(segs, ["key", "day"]).select("message_id", node.alias("node"))
    per_mail = member.groupBy("message_id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))  # a mail's own few keys
    together = per_mail.select("nodes").distinct().select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b"))
    runs = segs.groupBy("key", "segment").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    text_runs = runs.where(F.col("key").startswith("s|")).select(
        F.substring("key", 3, 64).alias("text_id"), node.alias("node"), "first", "last"
    )
    x, y = text_runs.alias("x"), text_runs.alias("y")
    near = (F.col("x.first") - window <= F.col("y.last")) & (F.col("y.first") - window <= F.col("x.last"))
    alike = similar_texts(texts_of(feats)).alias("p")
    by_text = alike.join(x, F.col("p.a") == F.col("x.text_id")).join(y, (F.col("p.b") == F.col("y.text_id")) & near).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")
    )
    component = connected_components(together.union(by_text))
    first_node = per_mail.select("message_id", F.col("nodes")[0].alias("node"))
    labelled = first_node.join(component, "node", "left").select("message_id", F.coalesce("component", "node").alias("component"))
    groups = labelled.groupBy("component").agg(F.min("message_id").alias("oldest"), F.count("*").alias("n")).where("n >= 2")
    return labelled.join(groups, "component").select(
        "message_id", F.concat(F.lit("camp-"), F.col("oldest").cast("string")).alias("campaign_id")
    )


def linking_pairs(feats: DataFrame, window: int = lists.WINDOW_SECONDS) -> DataFrame:
    """(key, a, b): per key and day each mail with the key's first mail of that day, and the last of a day
    with the first of the next. These pairs connect exactly what all pairs would, and there is one per mail.
    """
    keys = match_keys(feats)
    at = F.struct("t", "message_id")
    days = keys.groupBy("key", "day").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    within = keys.join(days, ["key", "day"]).where(F.col("message_id") != F.col("first.message_id")).select(
        "key", F.col("first.message_id").alias("a"), F.col("message_id").alias("b")
    )
    nxt = F.lead("first").over(Window.partitionBy("key").orderBy("day"))
    across = days.withColumn("next", nxt).where(F.col("next.t") - F.col("last.t") <= window).select(
        "key", F.col("last.message_id").alias("a"), F.col("next.message_id").alias("b")
    )
    return within.unionByName(across)


def _in_common(x: str, y: str) -> tuple[Column, Column]:
    """Whether two mails share a link host, and a sender domain that tells something."""
    c = F.col
    domain = (
        (c(f"{x}.sender_domain") != "") & (c(f"{x}.sender_domain") == c(f"{y}.sender_domain"))
        & ~c(f"{x}.sender_domain").isin(lists.CAMPAIGN_FREEMAIL)
    )
    return F.arrays_overlap(c(f"{x}.hosts"), c(f"{y}.hosts")), domain


def pair_score(x: str, y: str, window: int = lists.WINDOW_SECONDS, known: tuple[Column, Column, Column] | None = None) -> tuple[Column, Column]:
    """(score, reasons) of two feature rows under the aliases x and y. ``known``: whether they share a host and a sender domain, and their
    similarity, where these have been found before."""
    c = F.col
    host, domain, similarity = known or (*_in_common(x, y), txt.jaccard(c(f"{x}.shingles"), c(f"{y}.shingles")))
    inside = F.abs(c(f"{x}.t") - c(f"{y}.t")) <= window
    wording_points = F.when(similarity >= lists.NEAR_IDENTICAL, 2).when(similarity >= lists.SIMILAR, 1).otherwise(0)
    score = F.when(host, 2).otherwise(0) + F.when(domain, 2).otherwise(0) + wording_points
    reasons = F.array_join(F.array(
        F.when(host, "same link target"), F.when(domain, "same sender domain"),
        F.when(similarity >= lists.NEAR_IDENTICAL, "near-identical wording").when(similarity >= lists.SIMILAR, "similar wording"),
    ), ", ")
    return F.when(inside, score).otherwise(0), F.when(inside, reasons).otherwise("")


def matching_pairs(feats: DataFrame, window: int = lists.WINDOW_SECONDS) -> DataFrame:
    """(x, y, host, domain, similarity) of every pair of mails within the window that shares a host, a sender domain or near-identical wording: all
    pairs that can join a campaign, x(message_id, t) before y. ``similarity`` is exact from ``SIMILAR`` on and 0 below.

    Pairs are as many as they are; a key's mails meet by day and in parts, so that no key's pairs are one task's. A pair that shares several keys
    is made under the smallest of them, so pairs are not shuffled to be told apart. Texts are compared once for all mails that have them.
    """
    mails = feats.select("message_id", "t", "sender_domain", "hosts", "text_id").distinct()
    texts = cut_lineage(mails.where("text_id is not null").groupBy("text_id").agg(F.min("message_id").alias("text")))
    of = lambda side: texts.select(F.col("text_id").alias(side), F.col("text").alias(f"{side}_text"))
    alike = cut_lineage(similar_texts(texts_of(feats), lists.SIMILAR).join(of("a"), "a").join(of("b"), "b").select(
        F.least("a_text", "b_text").alias("p"), F.greatest("a_text", "b_text").alias("q"), "similarity"))
    keyed = cut_lineage(mails.join(texts, "text_id", "left").select("message_id", "t", "sender_domain", "hosts", "text", _keys().alias("keys")))
    mail, day = F.struct(*keyed.columns), F.floor(F.col("t") / window)
    x = keyed.select(mail.alias("x"), F.explode("keys").alias("key"), day.alias("day")).select(
        "x", "key", F.explode(F.array("day", F.col("day") + 1)).alias("day")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    y = keyed.select(mail.alias("y"), F.explode("keys").alias("key"), day.alias("day"), F.pmod(F.xxhash64("message_id"), F.lit(PARTS)).cast("int").alias("part"))
    at = lambda side: F.struct(f"{side}.t", f"{side}.message_id")
    before = (at("x") < at("y")) & (F.col("y.t") - F.col("x.t") <= window)
    host, domain = _in_common("x", "y")
    worded_both = F.col("x.text").isNotNull() & F.col("y.text").isNotNull()  # the least of a text and none would be the text
    row = [*(F.struct(f"{side}.message_id", f"{side}.t").alias(side) for side in ("x", "y")), host.alias("host"), domain.alias("domain")]
    met = x.join(y, ["key", "day", "part"]).where(before & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("key"))).select(
        *row, F.when(worded_both, F.least("x.text", "y.text")).alias("p"), F.greatest("x.text", "y.text").alias("q"))
    same = F.when(F.col("p") == F.col("q"), 1.0)
    keyed_pairs = met.join(alike, ["p", "q"], "left").select("x", "y", "host", "domain", F.coalesce(same, "similarity", F.lit(0.0)).alias("similarity"))
    close = alike.where(F.col("similarity") >= lists.NEAR_IDENTICAL)
    both = close.union(close.select("q", "p", "similarity"))
    by_text = lambda side, name: keyed.select(F.struct(*keyed.columns).alias(side), F.col("text").alias(name))
    worded = both.join(by_text("x", "p"), "p").join(by_text("y", "q"), "q").where(before & ~F.arrays_overlap("x.keys", "y.keys")).select(*row, "similarity")
    return keyed_pairs.unionByName(worded)


def traits_wording(members: DataFrame) -> DataFrame:
    """How much wording the mails of a campaign share: over all its mails the mean, over a mail's shingles, of the share
    of the other mails that have the shingle too. Counts per shingle, so it costs what the texts cost.

    ``members``: campaign_id, message_id, shingles (distinct in a mail).
    """
    sizes = members.groupBy("campaign_id").agg(F.count("*").alias("mails"))
    # Arrays travel, a part of a mail's shingles in each; the rows are made behind the exchange, which suits the grouping.
    hashed = members.select("campaign_id", F.size("shingles").alias("own"), F.transform("shingles", lambda s: F.xxhash64(s)).alias("hashed"))
    part = F.explode(F.array_distinct(F.transform("hashed", lambda s: F.pmod(s, F.lit(PARTS)))))
    dealt = hashed.select("campaign_id", "own", "hashed", part.alias("part")).select(
        "campaign_id", "part", "own", F.filter("hashed", lambda s: F.pmod(s, F.lit(PARTS)) == F.col("part")).alias("hashed"))
    # A number of partitions that stays: those joined by the size of the arrays would hold too many rows for one task, and spill.
    each = dealt.repartition(partitions(members.sparkSession), "campaign_id", "part").select("campaign_id", "part", "own", F.explode("hashed").alias("shingle"))
    counts = each.groupBy("campaign_id", "part", "shingle").agg(F.count("*").alias("k"), F.sum(1 / F.col("own")).alias("weight")).groupBy(
        "campaign_id", "part").agg(F.sum(F.col("weight") * (F.col("k") - 1)).alias("shared"))
    shared = counts.groupBy("campaign_id").agg(F.sum("shared").alias("shared")).join(sizes.where("mails > 1"), "campaign_id")
    return shared.select("campaign_id", (F.col("shared") / (F.col("mails") * (F.col("mails") - 1))).alias("mean"))
