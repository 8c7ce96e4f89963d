"""Retrieval metrics over ``qrels(qid, unit_id)``. An unresolved gold unit stays in the denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGETS = (512, 1024, 2048, 4096)
KS = (2, 5, 10)


def gold_counts(questions: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(qid, n_gold)`` of every question, 0 where it has none."""
    counts = qrels.select("qid", "unit_id").distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    return questions.select("qid").distinct().join(counts, "qid", "left").select("qid", F.coalesce("n_gold", F.lit(0)).alias("n_gold"))


def context_metrics(questions: DataFrame, contexts: DataFrame, qrels: DataFrame, budgets: DataFrame) -> DataFrame:
    """Gold recall, full support and precision of each question's context at each budget.

    No gold gives recall and support 0, an empty context precision 0.
    """
    gold = qrels.select("qid", "unit_id", F.lit(1).alias("is_gold")).distinct()
    found = contexts.join(gold, ["qid", "unit_id"], "left").groupBy("qid", "budget").agg(
        F.count("*").alias("units"), F.sum(F.coalesce("is_gold", F.lit(0))).alias("found")
    )
    frame = gold_counts(questions, qrels).crossJoin(F.broadcast(budgets.select(F.col("budget").cast("long").alias("budget"))))
    full = frame.join(found, ["qid", "budget"], "left").fillna(0, ["units", "found"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return full.select(
        "qid", "budget", "units", share("found", "n_gold").alias("gold_recall"),
        ((F.col("n_gold") > 0) & (F.col("found") == F.col("n_gold"))).cast("int").alias("full_support"), share("found", "units").alias("context_precision"),
    )


def rank_metrics(questions: DataFrame, hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, ndcg_at: int = 10) -> DataFrame:
    """Recall and full support at each k, and binary nDCG, whose ideal is cut at the number of gold units."""
    gold = qrels.select("qid", "unit_id").distinct()
    found = hits.select("qid", "unit_id", "rank").join(gold, ["qid", "unit_id"]).groupBy("qid").agg(
        *(F.sum((F.col("rank") <= k).cast("int")).alias(f"found_{k}") for k in ks),
        F.sum(F.when(F.col("rank") <= ndcg_at, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    full = gold_counts(questions, qrels).join(found, "qid", "left").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_gold", F.lit(ndcg_at)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    has = F.col("n_gold") > 0
    return full.select(
        "qid", "n_gold",
        *(F.when(has, F.col(f"found_{k}") / F.col("n_gold")).otherwise(0.0).alias(f"recall_{k}") for k in ks),
        *((has & (F.col(f"found_{k}") == F.col("n_gold"))).cast("int").alias(f"support_{k}") for k in ks),
        F.when(has, F.round(F.col("dcg") / ideal, 9)).otherwise(0.0).alias("ndcg"),
    )


def budget_means(outcomes: DataFrame) -> DataFrame:
    """Means over questions, per budget."""
    names = ("gold_recall", "full_support", "context_precision", "units")
    return outcomes.groupBy("budget").agg(*(F.round(F.avg(n), 9).alias(n) for n in names), F.count("*").alias("questions"), F.sum("full_support").alias("supported"))


def hits_at(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """Micro share of gold among the first k: one row."""
    gold = qrels.select("qid", "unit_id").distinct()
    ranked = gold.join(hits.select("qid", "unit_id", "rank"), ["qid", "unit_id"], "left")
    return ranked.agg(
        F.count("*").alias("gold"), *(F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 9).alias(f"hits_{k}") for k in ks)
    )


def reach(hits: DataFrame, qrels: DataFrame, read: DataFrame) -> DataFrame:
    """Gold outside the units read, and how much of it a component's list holds: one row."""
    outside = qrels.select("qid", "unit_id").distinct().join(read.select("qid", "unit_id"), ["qid", "unit_id"], "left_anti")
    listed = outside.join(hits.select("qid", "unit_id", F.lit(1).alias("hit")).distinct(), ["qid", "unit_id"], "left")
    return listed.agg(F.count("*").alias("outside"), F.coalesce(F.sum("hit"), F.lit(0)).alias("listed"), F.countDistinct("qid").alias("questions"))
