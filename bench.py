"""Runs the headline queries once and prints one JSON line."""

import json
import os
import time

from lurewatch.plans import catalog
from lurewatch.session import local_session

HEADLINE = [
    "sig_header_auth", "sig_content_urgency", "sig_lookalike_link", "sig_att_double_ext", "agg_assessment", "risk_levels",
    "campaign_clusters", "agg_trait_links", "win_escalation_change", "agg_incident", "containment_plan",
    "blast_nodes", "track_rewrite_text", "fn_shingles", "html_visible_text", "parse_body", "ml_prepare", "agg_roc_auc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=max(8, int(cores) if cores.isdigit() else 8), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time; views that several queries share are computed once", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
