"""Queries over the given tables, each with the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say the same."""
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  Text tables stored in fewer pieces than there are cores are spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in KEYS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, KEYS[name])
    return df


def load() -> None:
    """Import every module that registers queries."""
    from lectern.suite import (access_queries, analysis_queries, metadata_queries, rank_queries,  # noqa: F401
                               report_queries, search_queries, section_queries, state_queries, text_queries)
