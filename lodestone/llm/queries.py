"""The queries of this subpackage for the driver's contract, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bin_packing, dac_ids, divergence, fuzzy_lines, jaccard_join, pii, qgram_decontam, rff_classifier, url_filter, viterbi_count
from lodestone.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    return lambda spark, sf_dir: query(prepare(spark), sf_dir)


QUERIES: dict[str, Query] = {
    name: _prepared(query)
    for name, query in {
        "op1_divergence_rules": divergence.query,
        "op2_min_bin_slack": bin_packing.query,
        "op3_qgram_decontamination": qgram_decontam.query,
        "op4_quality_scores": rff_classifier.query,
        "op5_fuzzy_lines": fuzzy_lines.query,
        "op6_viterbi_counts": viterbi_count.query,
        "op7_dac_token_ids": dac_ids.query,
        "op8_jaccard_groups": jaccard_join.query,
        "op9_pii_spans": pii.query,
        "op10_url_verdicts": url_filter.query,
    }.items()
}

ORACLE_SQL: dict[str, str] = {"op8_jaccard_groups": jaccard_join.ORACLE, "op10_url_verdicts": url_filter.ORACLE}
