"""The registered queries over the given tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import analysis, analytics, answers, checks, entities, evidence, expansion, facts, filing, knowledge, language, layout, measures, retrieval, stores, streams, tables, uploads

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retrieval, analysis, analytics, evidence, streams, tables, facts, answers, language, filing, measures, knowledge, layout, checks, expansion, entities, uploads, stores)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top documents of every question by BM25."""
    return retrieval.bm25_topk(spark, sf_dir)
