"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import brown_lm, label_sharding, mixing, packed_negatives, packing, quality_ledger, simhash_pigeonhole, spelling_kd, token_offsets, topk_blocks, toxicity_cnn, url_aliases, zip_warc

_QUERIES = (
    (topk_blocks.op1_topk, topk_blocks.ORACLE),
    (packing.op2_packing, None),
    (zip_warc.op3_warc, zip_warc.ORACLE),
    (quality_ledger.op4_quality_rules, quality_ledger.ORACLE),
    (quality_ledger.quality_ablations, quality_ledger.ABLATIONS),
    (token_offsets.op5_token_counts, None),
    (toxicity_cnn.op6_toxicity, None),
    (simhash_pigeonhole.op7_simhash, None),
    (mixing.op8_mixing, None),
    (brown_lm.op9_brown_lm, None),
    (label_sharding.op10_sharding, None),
    (packed_negatives.op11_hard_negatives, packed_negatives.ORACLE),
    (url_aliases.op12_url_aliases, url_aliases.ORACLE),
    (spelling_kd.op13_spelling, spelling_kd.ORACLE),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f, _ in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _QUERIES if sql}
