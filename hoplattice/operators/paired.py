"""Paired comparisons of two systems on the same questions, and verdicts from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoplattice.functions import stats


def paired_table(a: DataFrame, b: DataFrame, success: str = "full_support") -> DataFrame:
    """``(qid, a, b)``; a question that only one side has is an error."""
    left = a.select("qid", F.col(success).alias("a"))
    right = b.select("qid", F.col(success).alias("b"))
    both = left.join(right, "qid", "full_outer")
    missing = F.raise_error(F.concat(F.lit("question on one side only: "), F.col("qid").cast("string")))
    return both.select("qid", F.when(F.col("a").isNull(), missing).otherwise(F.col("a")).alias("a"), F.when(F.col("b").isNull(), missing).otherwise(F.col("b")).alias("b"))


def cross_table(pairs: DataFrame) -> DataFrame:
    """One row: both, only a, only b, neither, and the number of questions."""
    cell = lambda x, y: F.coalesce(F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("long")), F.lit(0))
    return pairs.agg(cell(1, 1).alias("both"), cell(1, 0).alias("only_a"), cell(0, 1).alias("only_b"), cell(0, 0).alias("neither"), F.count("*").alias("n"))


def compared(table: DataFrame) -> DataFrame:
    """Adds the difference, the exact test, the one-sided sign test, Tango's interval and the three-way label."""
    p = F.round(stats.mcnemar("only_a", "only_b"), 9)
    tested = table.withColumns({"difference": F.round((F.col("only_a") - F.col("only_b")) / F.col("n"), 9), "p": p, "p_one_sided": F.round(stats.sign_test("only_a", "only_b"), 9), "limits": stats.tango_interval("only_a", "only_b", "n")})
    label = F.when((F.col("p") < 0.05) & (F.col("only_a") > F.col("only_b")), "supported").when((F.col("p") < 0.05) & (F.col("only_a") < F.col("only_b")), "regression").otherwise("not supported")
    return tested.withColumns({"low": F.round("limits.low", 6), "high": F.round("limits.high", 6), "label": label}).drop("limits")


def coverage_changes(a: DataFrame, b: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per question: gold units that only context b holds (gained) and only context a holds (lost)."""
    gold = qrels.select("qid", "unit_id").distinct()
    mark = lambda df, name: gold.join(df.select("qid", "unit_id").distinct(), ["qid", "unit_id"], "left_semi").withColumn(name, F.lit(1))
    both = gold.join(mark(a, "in_a"), ["qid", "unit_id"], "left").join(mark(b, "in_b"), ["qid", "unit_id"], "left").fillna(0, ["in_a", "in_b"])
    changed = lambda x, y: F.sum(((F.col(x) == 1) & (F.col(y) == 0)).cast("long"))
    return both.groupBy("qid").agg(changed("in_b", "in_a").alias("gained"), changed("in_a", "in_b").alias("lost"))


def ladder(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """Supported questions of each system, and the gain over the system before it in the declared order."""
    place = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("system"))
    rungs = outcomes.groupBy("system").agg(F.sum("full_support").cast("long").alias("supported"), F.round(F.avg("gold_recall"), 9).alias("gold_recall"))
    # one row a system
    w = Window.orderBy(place)
    return rungs.select("system", place.cast("int").alias("rung"), "supported", "gold_recall", (F.col("supported") - F.lag("supported").over(w)).alias("gain"))


def grouped(outcomes: DataFrame, groups: DataFrame) -> DataFrame:
    """Means by group ``(qid, group)``; a question may be in several."""
    return outcomes.join(groups, "qid").groupBy("group").agg(
        F.count("*").alias("questions"), F.sum("full_support").cast("long").alias("supported"), F.round(F.avg("gold_recall"), 9).alias("gold_recall")
    )


def differences(a: DataFrame, b: DataFrame, value: str = "gold_recall") -> DataFrame:
    """Histogram of b minus a per question."""
    both = a.select("qid", F.col(value).alias("a")).join(b.select("qid", F.col(value).alias("b")), "qid")
    return both.groupBy(F.round(F.col("b") - F.col("a"), 6).alias("difference")).agg(F.count("*").alias("questions"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks: the check that a replayed list equals the stored one."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def screen_verdict(table: DataFrame, margin_percent: int = 5) -> DataFrame:
    """``pass`` if the winner leads the better of two controls by the margin, in whole questions: 100 (W - max(T1, T2)) >= margin n."""
    lead = 100 * (F.col("w") - F.greatest("t1", "t2"))
    return table.withColumn("verdict", F.when((F.col("n") > 0) & (lead >= margin_percent * F.col("n")), "pass").otherwise("stop"))


def gate(table: DataFrame) -> DataFrame:
    """GO if both node types together beat the comparator and entities alone; NAMES_ONLY if entities alone beat the comparator; else STOP.

    ``anomaly`` marks patterns that show neither: both together, or concepts alone,
    beat the comparator while the outcome is STOP.
    """
    go = F.col("both_beat_comparator") & F.col("both_beat_entities")
    outcome = F.when(go, "GO").when(F.col("entities_beat_comparator"), "NAMES_ONLY").otherwise("STOP")
    odd = (outcome == "STOP") & (F.col("both_beat_comparator") | F.col("concepts_beat_comparator"))
    return table.withColumns({"outcome": outcome, "anomaly": odd})
