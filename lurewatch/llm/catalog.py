"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lurewatch.llm import conversations, extraction, language, language_model, mixing, negatives, oracles, pieces, quality, secrets, sketches, substrings, vectors, warc
from lurewatch.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_crf_extraction": _over("pages", extraction.digest),
        "op2_int8_tiles": _over("embeddings", vectors.digest),
        "op3_gru": _over("documents", language_model.digest),
        "op4_guess_cost": _over("documents", secrets.digest),
        "op5_weak_supervision": _over("documents", quality.digest),
        "op6_word_backoff": _over("documents", language.digest),
        "op7_warc_revisits": _over("pages", warc.digest),
        "op8_pfair": _over("documents", mixing.digest),
        "op9_sampled_pieces": _over("documents", pieces.digest),
        "op10_setsketch": _over("documents", sketches.digest),
        "op11_de_bruijn": _over("documents", substrings.digest),
        "op12_audit_dp": _over("conversations", conversations.digest),
        "op13_zone_maps": _over("embeddings", negatives.digest),
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_de_bruijn": oracles.REPEATED_RUNS, "op13_zone_maps": oracles.HARD_NEGATIVES}
