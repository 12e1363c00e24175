"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import model_queries, planted_queries, profile_queries, relational_queries, report_queries, statistics_queries, text_queries

_MODULES = (relational_queries, statistics_queries, text_queries, model_queries, profile_queries, planted_queries, report_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_queries.pattern_document(spark, sf_dir)
