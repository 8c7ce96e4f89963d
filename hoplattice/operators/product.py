"""Weighted fusion at every point of a grid as one matrix product a list: units x components by components x points.

Lists are short (their ranks are cut), so a list and its answers fit a task; what leaves it is the
first units or the tallies of each point, never a row for every unit and point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.operators.grids import simplex
from hoplattice.operators.rank import min_max


def weights_of(names: list[str], parts: int = 10) -> np.ndarray:
    """``names x points``: the grid's weights, points in the order of ``grids.weight_table``."""
    return np.array([[point[n] for point in simplex(names, parts)] for n in names])


def wide(lists: DataFrame, names: list[str], by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """One row for each unit of a list: its min-max score in each component, 0 where it is missing."""
    scaled = min_max(lists, ("component", *by))
    return scaled.groupBy(*by, "unit_id").agg(*(F.coalesce(F.max(F.when(F.col("component") == n, F.col("norm"))), F.lit(0.0)).alias(n) for n in names))


def _orders(table: pa.Table, names: list[str], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (units x points) of rows sorted by unit, and the places of the first ``k`` at each point."""
    values = np.column_stack([np.asarray(table.column(n), float) for n in names])
    # summed in the order of the names, so that any other way of adding them rounds alike
    scores = np.zeros((len(values), weights.shape[1]))
    for c in range(len(names)):
        scores += values[:, c : c + 1] * weights[c]
    scores = np.round(scores, 6) + 0.0
    return scores, np.argsort(-scores, axis=0, kind="stable")[:k]


def _schema(df: DataFrame, by: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"{c} {kinds[c]}, " for c in by)


def topk(lists: DataFrame, names: list[str], weights: np.ndarray, k: int = 100, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``(by..., point, unit_id, score, rank)``: the first ``k`` of each list at each point."""
    rows = wide(lists, names, by)

    def first(key, table):
        table = table.sort_by("unit_id")
        scores, order = _orders(table, names, weights, k)
        depth, points = order.shape
        columns = [pa.repeat(v, depth * points) for v in key]
        columns += [
            pa.array(np.repeat(np.arange(points), depth), pa.int32()), table.column("unit_id").take(pa.array(order.T.ravel())).combine_chunks(),
            pa.array(np.take_along_axis(scores, order, axis=0).T.ravel()), pa.array(np.tile(np.arange(1, depth + 1), points), pa.int32()),
        ]
        return pa.table(dict(zip([*by, "point", "unit_id", "score", "rank"], columns, strict=True)))

    unit = dict(rows.dtypes)["unit_id"]
    return rows.groupBy(*by).applyInArrow(first, _schema(rows, by) + f"point int, unit_id {unit}, score double, rank int")


def outcomes(
    lists: DataFrame, names: list[str], weights: np.ndarray, gold: DataFrame, by: tuple[str, ...] = ("qid",), depth: int = 10,
    tokens: DataFrame | None = None, budgets: tuple[int, ...] = (), k: int = 100,
) -> DataFrame:
    """``(by..., point, budget, units, found)`` of every list at every point.

    A null budget stands for the first ``depth`` units; each other one for the greedy fill of the first ``k`` that
    skips what does not fit, with all points filled side by side. A unit without a count in ``tokens`` is an error.
    """
    rows = wide(lists, names, by).join(gold.select("qid", "unit_id", F.lit(1).alias("gold")).distinct(), ["qid", "unit_id"], "left").fillna(0, ["gold"])
    if budgets:
        cost = tokens.select("unit_id", F.col("n_tokens").cast("long").alias("n_tokens"))
        missing = F.raise_error(F.concat(F.lit("no token count for unit "), F.col("unit_id").cast("string")))
        rows = rows.join(cost, "unit_id", "left").withColumn("n_tokens", F.when(F.col("n_tokens").isNull(), missing).otherwise(F.col("n_tokens")))

    def tallies(key, table):
        table = table.sort_by("unit_id")
        _, order = _orders(table, names, weights, max(k, depth))
        held = np.asarray(table.column("gold"), np.int64)
        points = order.shape[1]
        units, found = [np.full(points, len(order[:depth]))], [held[order[:depth]].sum(axis=0)]
        for budget in budgets:
            cost, used = np.asarray(table.column("n_tokens"), np.int64), np.zeros(points, np.int64)
            n, hit = np.zeros(points, np.int64), np.zeros(points, np.int64)
            for place in order[:k]:
                fits = used + cost[place] <= budget
                used, n, hit = used + cost[place] * fits, n + fits, hit + held[place] * fits
            units.append(n)
            found.append(hit)
        repeats = 1 + len(budgets)
        columns = [pa.repeat(v, points * repeats) for v in key]
        columns += [
            pa.array(np.tile(np.arange(points), repeats), pa.int32()), pa.array([b for b in (None, *budgets) for _ in range(points)], pa.int64()),
            pa.array(np.concatenate(units), pa.int64()), pa.array(np.concatenate(found), pa.int64()),
        ]
        return pa.table(dict(zip([*by, "point", "budget", "units", "found"], columns, strict=True)))

    return rows.groupBy(*by).applyInArrow(tallies, _schema(rows, by) + "point int, budget long, units long, found long")


def summary(tallied: DataFrame, gold_counts: DataFrame, over: tuple[str, ...] = ()) -> DataFrame:
    """Per point (and what ``over`` names): gold found, mean recall, and questions whose gold is all found; of questions with gold."""
    scored = tallied.join(gold_counts.where("n_gold > 0"), "qid")
    return scored.groupBy(*over, "point", "budget").agg(
        F.sum("found").alias("found"), F.round(F.avg(F.col("found") / F.col("n_gold")), 9).alias("recall"), F.sum((F.col("found") == F.col("n_gold")).cast("long")).alias("supported")
    )
