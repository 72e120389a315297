"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import ann, divergence, importance, language_id, line_dedup, near_dup, packing, pieces, pii, quality_model, quality_rules, secrets, voronoi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_crf": pii.op1_pii_crf,
    "op2_quality_bradley_terry": quality_model.op2_quality_bradley_terry,
    "op3_ann_small_world": ann.op3_ann_small_world,
    "op4_minhash_tensored": near_dup.op4_minhash_tensored,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_language_naive_bayes": language_id.op6_language_naive_bayes,
    "op7_sentencepiece_lattice": pieces.op7_sentencepiece_lattice,
    "op8_secrets_crf": secrets.op8_secrets_crf,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_packing_vector_best_fit": packing.op10_packing_vector_best_fit,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_exact_top_k": voronoi.op12_exact_top_k,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op11_importance_resampling": importance.ORACLE_SQL,
    "op12_exact_top_k": voronoi.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
