"""Ranked lists: ranks, cuts, per-query ranges and hash-ordered choices.

The one contract of every list is ``(qid, unit_id, score)``; order is score
descending, then unit id ascending, and is written out as ``rank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(score: Column, digits: int = 6) -> Column:
    """Scores are ranked as rounded, so the order of a sum's terms can't change a rank."""
    return F.round(score, digits)


def with_rank(hits: DataFrame, by: tuple[str, ...] = ("qid",), order: tuple[Column, ...] | None = None) -> DataFrame:
    """Adds ``rank`` from 1 within each list."""
    order = order or (F.desc("score"), F.asc("unit_id"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(hits: DataFrame, k: int, by: tuple[str, ...] = ("qid",), order: tuple[Column, ...] | None = None) -> DataFrame:
    """The first ``k`` of each list; Spark cuts before the shuffle as well."""
    return with_rank(hits, by, order).where(F.col("rank") <= k)


def min_max(hits: DataFrame, by: tuple[str, ...] = ("qid",), score: str = "score", out: str = "norm") -> DataFrame:
    """Adds the score scaled to its list's own range; a constant list abstains with 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(out, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(0.0)))


def hash_subset(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows by ``sha1("seed:key")``."""
    order = F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("order_key", order).orderBy("order_key", key).limit(n)


def hash_split(df: DataFrame, key: str, n_dev: int, seed: int = 42) -> DataFrame:
    """Every row, with ``split``: dev for the first ``n_dev`` in hash order, else test.

    The bound is the n-th key, found by a bounded top-n; no window over all rows.
    """
    keyed = df.withColumn("order_key", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    last = keyed.select("order_key").orderBy("order_key").limit(n_dev).agg(F.max("order_key")).first()[0]
    return keyed.withColumn("split", F.when(F.col("order_key") <= F.lit(last), "dev").otherwise("test"))


def order_problems(hits: DataFrame) -> DataFrame:
    """Per list: places where the order is broken and units that repeat (0 and 0 for a sound list)."""
    w = Window.partitionBy("qid").orderBy("rank")
    before, unit = F.lag("score").over(w), F.lag("unit_id").over(w)
    broken = (F.col("score") > before) | ((F.col("score") == before) & (F.col("unit_id") <= unit))
    marked = hits.withColumn("broken", F.coalesce(broken, F.lit(False)).cast("int"))
    return marked.groupBy("qid").agg(
        F.sum("broken").alias("out_of_order"), (F.count("*") - F.countDistinct("unit_id")).alias("repeated"), F.count("*").alias("n")
    )


def best_rank(lists: DataFrame) -> DataFrame:
    """Smallest rank of each unit over systems."""
    return lists.groupBy("qid", "unit_id").agg(F.min("rank").alias("best_rank"))


def truncate_rows(weights: DataFrame, m: int, row: str = "unit_id", column: str = "node_id") -> DataFrame:
    """The ``m`` strongest entries of each row of a sparse matrix."""
    w = Window.partitionBy(row).orderBy(F.desc("w"), F.asc(column))
    return weights.withColumn("place", F.row_number().over(w)).where(F.col("place") <= m).drop("place")
