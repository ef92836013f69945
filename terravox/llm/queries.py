"""Queries of the corpus operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit, bpe, doubling, jaccard, licenses, middle, packing, pitman_yor, quality, sharding, spelling, toxicity, webp


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor_scores": pitman_yor.query,
    "op2_toxicity": toxicity.query,
    "op3_jaccard_join": jaccard.query,
    "op4_byte_bpe": bpe.query,
    "op5_license_scan": licenses.query,
    "op6_lossless_webp": webp.query,
    "op7_slot_sharding": sharding.query,
    "op8_substring_dedup": doubling.query,
    "op9_quality_rules": quality.query,
    "op10_packing": packing.query,
    "op11_best_fit_packing": bestfit.query,
    "op12_fill_in_middle": middle.query,
    "op13_spelling_variants": spelling.query,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op5_license_scan": licenses.oracle(), "op12_fill_in_middle": middle.oracle()}
