"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import op01_prefix_targets, op02_chosen_path_join, op03_winnow_lines, op04_feistel_shards, op05_guess_cost_secrets, op06_kneser_ney_quality, op07_transport_streams, op08_itq_neardup, op09_low_discrepancy_mix, op10_nnls_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_targets": op01_prefix_targets.query,
    "op2_chosen_path_join": op02_chosen_path_join.query,
    "op3_winnow_lines": op03_winnow_lines.query,
    "op4_feistel_shards": op04_feistel_shards.query,
    "op5_guess_cost_secrets": op05_guess_cost_secrets.query,
    "op6_kneser_ney_quality": op06_kneser_ney_quality.query,
    "op7_transport_streams": op07_transport_streams.query,
    "op8_itq_neardup": op08_itq_neardup.query,
    "op9_low_discrepancy_mix": op09_low_discrepancy_mix.query,
    "op10_nnls_packing": op10_nnls_packing.query,
}

ORACLES: dict[str, str] = {
    "op1_prefix_targets": op01_prefix_targets.ORACLE,
    "op2_chosen_path_join": op02_chosen_path_join.ORACLE,
    "op3_winnow_lines": op03_winnow_lines.ORACLE,
    "op4_feistel_shards": op04_feistel_shards.ORACLE,
    "op8_itq_neardup": op08_itq_neardup.ORACLE,
    "op9_low_discrepancy_mix": op09_low_discrepancy_mix.ORACLE,
}
