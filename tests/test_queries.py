"""A cross-section of the queries against their oracles; `python -m tests.check` runs all of them."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
NAMES = ["sig_header_auth", "sig_lookalike_link", "sig_content_urgency", "agg_assessment", "campaign_clusters", "incident_route",
         "win_escalation_change", "checklist_state", "containment_plan", "blast_edges", "track_rewrite_text", "agg_roc_auc",
         "parse_sender", "st_event_dedupe", "st_password_signin", "st_campaign_incremental", "src_eml_files", "udtf_parse_eml",
         "parse_headers", "link_dedupe", "src_llm_responses", "src_labelled_corpora", "sink_message_upsert", "st_change_feed", "sink_change_feed",
         "join_link_incidents", "agg_checklist_progress"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_no_signal_twice(spark):
    t = entry.queries()["set_union_signals"](spark, FOLDER)
    assert t.groupBy("message_id", "rule_id").count().where("count > 1").isEmpty()
