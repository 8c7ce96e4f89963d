"""Parameter grids as small tables, and choices among their points."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def simplex(names: list[str], parts: int = 10) -> list[dict[str, float]]:
    """Every way to give the names shares of 1 in steps of ``1 / parts``."""
    found = (c for c in product(range(parts + 1), repeat=len(names)) if sum(c) == parts)
    return [{n: k / parts for n, k in zip(names, c, strict=True)} for c in found]


def weight_table(spark: SparkSession, names: list[str], parts: int = 10) -> DataFrame:
    """``(point, w_<name>...)`` of a simplex: 66 points for three names, 286 for four, in tenths."""
    rows = [(k, *(point[n] for n in names)) for k, point in enumerate(simplex(names, parts))]
    return spark.createDataFrame(rows, "point int, " + ", ".join(f"w_{n} double" for n in names))


def choose(points: DataFrame, *order: Column) -> DataFrame:
    """The one point that comes first in the order."""
    return points.orderBy(*order).limit(1)


def contenders(points: DataFrame, value: str, margin: Column | float) -> DataFrame:
    """Points within the margin of the best."""
    best = F.max(value).over(Window.partitionBy())  # a grid is a small table
    return points.withColumn("best", best).where(F.col(value) >= F.col("best") - margin).drop("best")


def null_as_all(cap: Column) -> Column:
    """Missing caps mean no cap, and order after every number."""
    return F.coalesce(cap.cast("double"), F.lit(float("inf")))


def scale_outcome(sizes: DataFrame) -> DataFrame:
    """How two systems' lead changes from the smallest to the largest corpus ``(size, a, b)``: one row.

    crossover (the lead changes sides), both_degrade (both fall), convergence (the
    lead shrinks), stable_ranking otherwise.
    """
    ends = sizes.agg(
        F.min_by("a", "size").alias("a0"), F.min_by("b", "size").alias("b0"), F.max_by("a", "size").alias("a1"), F.max_by("b", "size").alias("b1")
    )
    first, last = F.col("a0") - F.col("b0"), F.col("a1") - F.col("b1")
    outcome = (
        F.when(first * last < 0, "crossover")
        .when((F.col("a1") < F.col("a0")) & (F.col("b1") < F.col("b0")), "both_degrade")
        .when(F.abs(last) < F.abs(first), "convergence")
        .otherwise("stable_ranking")
    )
    return ends.withColumn("outcome", outcome)
