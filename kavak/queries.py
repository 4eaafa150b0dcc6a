"""Queries of the core: name -> (spark, folder) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kavak import oracle, oracle_review, oracle_store
from kavak.plans import content, curriculum, learners, review, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (*curriculum.QUERIES, *learners.QUERIES, *store.QUERIES, *review.QUERIES, content.p1_found, content.p1_places, content.p4_found, content.p4_report, content.p4_composite)
}
ORACLE = oracle.ORACLE | oracle_store.ORACLE | oracle_review.ORACLE
