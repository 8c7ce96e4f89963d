"""Checks and verdicts on small tables of results: comparability, reproduction, order of freezing, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable(results: DataFrame, *keys: str) -> DataFrame:
    """One row: whether all results agree in every key (corpus, tokenizer, seed, depth)."""
    return results.agg(*(F.countDistinct(k).alias(k) for k in keys)).select(*keys, F.least(*(F.col(k) <= 1 for k in keys), F.lit(True)).alias("comparable"))


def reproduction(recorded: DataFrame, repeated: DataFrame, value: str = "value", tolerance: float = 1e-5) -> DataFrame:
    """One row: questions, those on one side only, those whose value differs, the largest difference and the verdict."""
    both = recorded.select("qid", F.col(value).alias("x")).join(repeated.select("qid", F.col(value).alias("y")), "qid", "full_outer")
    gap = F.abs(F.col("x") - F.col("y"))
    out = both.agg(
        F.count("*").alias("questions"), F.sum((F.col("x").isNull() | F.col("y").isNull()).cast("int")).alias("unmatched"),
        F.sum((gap > tolerance).cast("int")).alias("differing"), F.max(gap).alias("largest"),
    )
    return out.withColumn("verdict", F.when((F.col("unmatched") == 0) & (F.coalesce("differing", F.lit(0)) == 0), "reproduced").otherwise("differs"))


def contamination(table: DataFrame, limit_points: float = 5.0) -> DataFrame:
    """``clean`` where two success shares differ by the limit at most, in percentage points."""
    return table.withColumn("verdict", F.when(F.abs(100 * (F.col("a") / F.col("n_a") - F.col("b") / F.col("n_b"))) <= limit_points, "clean").otherwise("stop"))


def latency(table: DataFrame) -> DataFrame:
    """``stop`` beyond a mean of one second; ``columnwise`` from 0.8 seconds; else ``rowwise``."""
    return table.withColumn("verdict", F.when(F.col("mean_s") > 1.0, "stop").when(F.col("mean_s") >= 0.8, "columnwise").otherwise("rowwise"))


def frozen_first(runs: DataFrame) -> DataFrame:
    """Runs whose parameters weren't frozen before they were measured."""
    return runs.where(F.col("frozen_at").isNull() | (F.to_timestamp("frozen_at") >= F.to_timestamp("measured_at")))


def retention_bar(reference: Column, percent: int) -> Column:
    """Least whole number of questions that keeps the percentage of the reference's."""
    return F.ceil(reference * percent / 100)


def extractor_choice(table: DataFrame) -> DataFrame:
    """Of the extractors that reach both bars, the cheapest; ties by hours, then the better headline, then id."""
    passed = table.where((F.col("headline") >= F.col("headline_bar")) & (F.col("hop") >= F.col("hop_bar")))
    return passed.orderBy("usd", "hours", F.desc("headline"), "id").limit(1)


def projected_hours(units: Column, per_second: Column) -> Column:
    return units / per_second / 3600


def projected_cost(input_tokens: Column, output_tokens: Column, usd_per_input: float, usd_per_output: float) -> Column:
    """Cost at prices per million tokens."""
    return (input_tokens * usd_per_input + output_tokens * usd_per_output) / 1_000_000


def state_decision(table: DataFrame, rules: DataFrame) -> DataFrame:
    """The decision of each state ``(s, v, n)`` from a table of rules that must name every state once."""
    out = table.join(F.broadcast(rules), ["s", "v", "n"], "left")
    return out.withColumn("decision", F.when(F.col("decision").isNull(), F.raise_error(F.lit("state without a rule"))).otherwise(F.col("decision")))


def same_article(entered: DataFrame, articles: DataFrame) -> DataFrame:
    """Gold that entered a context ``(qid, unit_id, p1)``: counts by whether it shares the first unit's article."""
    own = articles.select(F.col("unit_id").alias("p1"), F.col("article").alias("p1_article"))
    both = entered.join(articles, "unit_id").join(own, "p1")
    return both.groupBy((F.col("article") == F.col("p1_article")).alias("same_article")).agg(F.count("*").alias("gold"), F.countDistinct("qid").alias("questions"))


def repeated_fact(context: DataFrame, holders: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: gold outside the context whose fact another unit ``(qid, gold_id, unit_id)`` in the context repeats."""
    gold = qrels.select("qid", F.col("unit_id").alias("gold_id"))
    missing = gold.join(context.select("qid", F.col("unit_id").alias("gold_id")), ["qid", "gold_id"], "left_anti")
    other = holders.where("unit_id <> gold_id").join(context.select("qid", "unit_id"), ["qid", "unit_id"], "left_semi")
    return missing.join(other.select("qid", "gold_id").distinct(), ["qid", "gold_id"], "left_semi").agg(F.count("*").alias("gold"), F.countDistinct("qid").alias("questions"))
