"""Pools of several systems' lists, re-ordering by a judge's scores, and what changed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.functions.text import dense_rank_class
from hoplattice.operators.rank import rounded, top_k, with_rank
from hoplattice.operators.vector import projected, sampled_dots
from hoplattice.sources.tables import stored


def pool(lists: DataFrame, depth: int = 100) -> DataFrame:
    """Union of each system's first units ``(system, qid, unit_id, rank)``: ranks by system, order by best rank, then id."""
    united = lists.where(F.col("rank") <= depth).groupBy("qid", "unit_id").agg(
        F.min("rank").alias("best_rank"), F.count("*").alias("systems"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("system", "rank")))).alias("ranks"),
    )
    return with_rank(united, order=(F.asc("best_rank"), F.asc("unit_id"))).withColumnRenamed("rank", "place")


def reorder(hits: DataFrame, judged: DataFrame, depth: int = 100) -> DataFrame:
    """The first units by judge's score ``(qid, unit_id, judge)``; ties keep the original rank. A missing score is an error."""
    first = hits.where(F.col("rank") <= depth).join(judged.select("qid", "unit_id", "judge"), ["qid", "unit_id"], "left")
    known = F.when(F.col("judge").isNull() | F.isnan("judge"), F.raise_error(F.lit("unit without a finite judge score"))).otherwise(F.col("judge"))
    scored = first.withColumn("judge", known).withColumnRenamed("rank", "before")
    return with_rank(scored, order=(F.desc("judge"), F.asc("before")))


def union_order(pooled: DataFrame, judged: DataFrame) -> DataFrame:
    """The whole pool by judge's score; ties by best rank, then id."""
    return with_rank(pooled.join(judged, ["qid", "unit_id"]), order=(F.desc("judge"), F.asc("best_rank"), F.asc("unit_id")))


def ceiling(pooled: DataFrame, qrels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: questions whose gold is all in the pool, those supported, and failures with all gold in the pool."""
    gold = qrels.select("qid", "unit_id").distinct()
    inside = gold.join(pooled.select("qid", "unit_id", F.lit(1).alias("hit")), ["qid", "unit_id"], "left")
    per_question = inside.groupBy("qid").agg((F.count("*") == F.count("hit")).cast("int").alias("all_inside"))
    both = per_question.join(outcomes.select("qid", "full_support"), "qid")
    return both.agg(
        F.count("*").alias("questions"), F.sum("all_inside").alias("all_inside"), F.sum("full_support").alias("supported"),
        F.sum(((F.col("all_inside") == 1) & (F.col("full_support") == 0)).cast("int")).alias("failures_inside"),
    )


def rank_split(changed: DataFrame, dense: DataFrame) -> DataFrame:
    """Gained and lost gold ``(qid, unit_id, change)`` by where it stood in the dense list."""
    ranked = changed.join(dense.select("qid", "unit_id", "rank"), ["qid", "unit_id"], "left")
    return ranked.groupBy("change", dense_rank_class(F.col("rank")).alias("rank_class")).agg(F.count("*").alias("n"))


def first_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: questions whose first unit differs between two lists, and their share."""
    first = lambda df, name: df.where("rank = 1").select("qid", F.col("unit_id").alias(name))
    both = first(a, "a").join(first(b, "b"), "qid")
    return both.agg(F.count("*").alias("questions"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("changed"), F.round(F.avg((F.col("a") != F.col("b")).cast("double")), 9).alias("share"))


def overlap_at(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Per question: how many of two lists' first k are the same."""
    x, y = (df.where(F.col("rank") <= k).select("qid", "unit_id") for df in (a, b))
    return x.join(y, ["qid", "unit_id"]).groupBy("qid").agg(F.count("*").alias("shared"))


def judged_by_overlap(pairs: DataFrame) -> DataFrame:
    """Stand-in for a model's judge over ``(qid, unit_id, question, text)``: shared distinct words; not a model's quality."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit("([a-z0-9]{2,})")))
    return pairs.select("qid", "unit_id", F.size(F.array_intersect(words("question"), words("text"))).cast("double").alias("judge"))


def top_pool(pooled: DataFrame, k: int) -> DataFrame:
    """The pool's first k of each question."""
    return top_k(pooled.withColumn("score", -F.col("best_rank")), k)


def two_tower(pairs: DataFrame, questions: DataFrame, units: DataFrame, question_tower: np.ndarray, unit_tower: np.ndarray, scale: float) -> DataFrame:
    """``(qid, unit_id, judge)``: scaled inner products of both sides' projections, for the given pairs.

    Units are projected once each and stored; pairs are scored where the units lie. A logit that is not finite is an error.
    """
    z = stored(projected(units, unit_tower, "unit_id"), "unit-tower")
    sims = sampled_dots(pairs, projected(questions, question_tower, "qid"), z, digits=12)
    sound = ~F.isnan("sim") & (F.abs("sim") < float("inf"))
    logit = rounded(F.lit(float(scale)) * F.col("sim"))
    return sims.select("qid", "unit_id", F.when(sound, logit).otherwise(F.raise_error(F.lit("a logit is not finite")).cast("double")).alias("judge"))


def bounded_rank_split(candidate: DataFrame, control: DataFrame, dense: DataFrame) -> DataFrame:
    """Where the gold that changed coverage stood in the dense list, bounded from totals alone: rows ``won``, ``lost`` and ``total``.

    ``candidate`` and ``control`` are ``(qid, units, gold_recall, full_support, context_precision)``, ``dense`` ``(qid, recall_10)``.
    A question counts if one side alone has full support. The winner's totals give the number of gold units, the loser's
    recall how many of them changed, the dense recall how many stand in its first ten: changed ones that must be among these are
    ``in_10``, those that can't be ``beyond_10``, the rest ``undetermined``. Unlike question sets are an error.
    """
    side = lambda df, p: df.select("qid", *(F.col(c).alias(f"{p}_{c}") for c in ("units", "gold_recall", "full_support", "context_precision")))
    both = side(candidate, "a").join(side(control, "b"), "qid", "full").join(dense.select("qid", F.col("recall_10").alias("d")), "qid", "full")
    both = stored(both, "outcomes")
    lacking = both.where("a_units IS NULL OR b_units IS NULL OR d IS NULL").select("qid").first()
    if lacking:
        raise ValueError(f"a run lacks question {lacking['qid']}")
    apart = both.where("a_full_support <> b_full_support")
    won = F.col("a_full_support") == 1
    pick = lambda c, winner: F.when(won if winner else ~won, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    whole = lambda c: F.round(c).cast("long")
    counted = apart.select(won.alias("won"), "d", whole(pick("context_precision", True) * pick("units", True)).alias("gold"), pick("gold_recall", False).alias("kept"))
    counted = counted.withColumns({"changed": whole(F.col("gold") * (1 - F.col("kept"))), "top": whole(F.col("gold") * F.col("d"))})
    surely, maybe = F.greatest(F.lit(0), F.col("top") - (F.col("gold") - F.col("changed"))), F.least("changed", "top")
    bounded = counted.select("won", "changed", surely.alias("in_10"), (F.col("changed") - maybe).alias("beyond_10"), (maybe - surely).alias("undetermined"))
    rows = bounded.withColumn("outcome", F.explode(F.array(F.when(F.col("won"), "won").otherwise("lost"), F.lit("total"))))
    names = ("changed", "in_10", "beyond_10", "undetermined")
    return rows.groupBy("outcome").agg(F.count("*").alias("questions"), *(F.sum(n).alias(n) for n in names))


def pilot(first: DataFrame, gold: DataFrame, depth: int = 10) -> DataFrame:
    """``(qid, p1, unit_id)``: gold that a list's first ``depth`` units miss, with the list's first unit; questions that miss none are no pilots."""
    read = first.where(F.col("rank") <= depth)
    missing = gold.select("qid", "unit_id").distinct().join(read.select("qid", "unit_id"), ["qid", "unit_id"], "left_anti")
    return missing.join(read.where("rank = 1").select("qid", F.col("unit_id").alias("p1")), "qid").select("qid", "p1", "unit_id")


def navigation(arms: DataFrame, missing: DataFrame, depths: tuple[int, ...] = (10, 100)) -> DataFrame:
    """Per arm: missing units and questions, and at each depth the units found and the questions with one; all arms in one join.

    ``arms(arm, qid, unit_id, rank)``; an arm that finds nothing has a row of zeros.
    """
    wanted = missing.select("qid", "unit_id").distinct()
    names = arms.select("arm").distinct()
    found = arms.join(wanted, ["qid", "unit_id"]).select("arm", "qid", "unit_id", "rank")
    within = lambda k: F.col("rank") <= k
    tallies = [c for k in depths for c in (F.sum(within(k).cast("long")).alias(f"found_{k}"), F.count_distinct(F.when(within(k), F.col("qid"))).alias(f"questions_{k}"))]
    totals = wanted.agg(F.count("*").alias("missing"), F.count_distinct("qid").alias("questions"))
    return names.crossJoin(F.broadcast(totals)).join(found.groupBy("arm").agg(*tallies), "arm", "left").fillna(0)
