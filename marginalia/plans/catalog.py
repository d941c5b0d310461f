"""Names, queries and SQL of the core operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import note_sql, searches, states, streams
from marginalia.plans.scalars import SCALARS


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search for all stored queries."""
    return searches.hybrid_search(spark, folder)


def queries() -> dict:
    return {name: scalar.query for name, scalar in SCALARS.items()} | searches.QUERIES | states.QUERIES | streams.QUERIES


def oracle_sql() -> dict:
    return {name: sql for name, scalar in SCALARS.items() if (sql := scalar.oracle())} | note_sql.SQL | searches.SQL | states.SQL | streams.SQL
