"""Fusions of ranked lists ``(component, qid, unit_id, score)``."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.operators.rank import min_max, rounded, top_k, with_rank

# Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60


def components(**lists: DataFrame) -> DataFrame:
    """One table of several lists, named by component."""
    parts = [df.select(F.lit(name).alias("component"), "qid", "unit_id", "score") for name, df in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def repeated(lists: DataFrame) -> DataFrame:
    """Units that one list holds more than once; a sound input has none."""
    return lists.groupBy("component", "qid", "unit_id").count().where("count > 1")


def union_of(lists: DataFrame) -> DataFrame:
    """Distinct units of all components."""
    return lists.select("qid", "unit_id").distinct()


def check_convex(weights: Mapping[str, float]) -> None:
    """Weights must not be negative and must sum to 1."""
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError(f"weights are not convex: {dict(weights)}")


def weighted(lists: DataFrame, weights: Mapping[str, float], k: int = 100) -> DataFrame:
    """Convex sum of min-max scores; a unit that a component lacks counts 0 there, and a weight of 0 keeps its units."""
    check_convex(weights)
    scaled = min_max(lists, ("component", "qid"))
    weight = reduce(lambda e, kv: F.when(F.col("component") == kv[0], F.lit(float(kv[1]))).otherwise(e), weights.items(), F.lit(0.0))
    return top_k(scaled.groupBy("qid", "unit_id").agg(rounded(F.sum(weight * F.col("norm"))).alias("score")), k)


def rrf(lists: DataFrame, k: int = 100) -> DataFrame:
    """Reciprocal ranks summed; a missing unit adds nothing."""
    ranked = with_rank(lists, ("component", "qid"))
    return top_k(ranked.groupBy("qid", "unit_id").agg(rounded(F.sum(1 / (RRF_K + F.col("rank")))).alias("score")), k)


def grid(lists: DataFrame, points: DataFrame, names: list[str], k: int = 100) -> DataFrame:
    """Weighted fusion at every grid point ``(point, w_<name>...)`` in one job; the grid is a small table.

    Lists are pivoted to one row per unit first, so the grid multiplies fused rows
    and not the components' rows.
    """
    scaled = min_max(lists, ("component", "qid"))
    wide = scaled.groupBy("qid", "unit_id").agg(*(F.coalesce(F.max(F.when(F.col("component") == n, F.col("norm"))), F.lit(0.0)).alias(n) for n in names))
    score = sum((F.col(f"w_{n}") * F.col(n) for n in names), F.lit(0.0))
    at_points = wide.crossJoin(F.broadcast(points)).select("point", "qid", "unit_id", rounded(score).alias("score"))
    return top_k(at_points, k, ("point", "qid"))
