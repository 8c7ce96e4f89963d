"""Names of the queries over the data tables, and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hoplattice.plans import corpora, further, graphs, retrieval, runs, stages


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retrieval.QUERIES | graphs.QUERIES | corpora.QUERIES | further.QUERIES | stages.QUERIES | runs.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.ORACLE_SQL | graphs.ORACLE_SQL | corpora.ORACLE_SQL | further.ORACLE_SQL | stages.ORACLE_SQL | runs.ORACLE_SQL
