"""Seed sets of query-aware hops: from question entities, from sentences, from windows around mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoplattice.operators.rank import rounded
from hoplattice.sources.tables import small


def from_question(spans: DataFrame, nodes: DataFrame, node_weights: DataFrame) -> DataFrame:
    """``(qid, node_id, w)``: nodes whose form is one of the question's spans ``(qid, form)``; a question without any has no rows."""
    matched = nodes.join(small(spans.where("form <> ''").distinct()), "form").select("qid", "node_id").distinct()
    return matched.join(node_weights.select("node_id", "w"), "node_id")


def first_mentions(located: DataFrame) -> DataFrame:
    """The node first mentioned in each question's unit ``(qid, node_id, sentence, offset)``."""
    return located.groupBy("qid").agg(F.min_by("node_id", F.struct("sentence", "offset", "node_id")).alias("node_id"))


def from_sentences(located: DataFrame, relevance: DataFrame, s: int | None, excluded: DataFrame | None = None) -> DataFrame:
    """Nodes of the ``s`` most relevant sentences that hold an eligible node; all sentences if ``s`` is None.

    ``located(qid, sentence, node_id)``, ``relevance(qid, sentence, rel)``; nodes in
    ``excluded(qid, node_id)`` (those the question names) aren't eligible. Ties go to
    the earlier sentence.
    """
    eligible = located if excluded is None else located.join(excluded.select("qid", "node_id").distinct(), ["qid", "node_id"], "left_anti")
    if s is not None:
        holding = eligible.select("qid", "sentence").distinct().join(relevance, ["qid", "sentence"])
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "sentence"))
        eligible = eligible.join(holding.withColumn("place", place).where(F.col("place") <= s), ["qid", "sentence"], "left_semi")
    return eligible.select("qid", "node_id").distinct()


def from_windows(windows: DataFrame, node_weights: DataFrame, m: int | None) -> DataFrame:
    """The ``m`` nodes whose best window ``(qid, node_id, sim)`` is nearest the question; ties by rarity, then id; all if ``m`` is None."""
    best = windows.groupBy("qid", "node_id").agg(rounded(F.max("sim")).alias("score")).join(node_weights.select("node_id", "w"), "node_id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("w"), "node_id"))
    ranked = best.withColumn("place", place)
    return ranked if m is None else ranked.where(F.col("place") <= m)


def coverage(located: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: nodes that should be located ``(qid, node_id)``, those that were, and the share."""
    both = wanted.select("qid", "node_id").distinct().join(located.select("qid", "node_id", F.lit(1).alias("hit")).distinct(), ["qid", "node_id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("located"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 9).alias("share"))
