"""Token-budgeted contexts: the greedy fill that skips what does not fit and goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_contexts(hits: DataFrame, tokens: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(qid, budget, unit_id, place)`` for every budget; a unit without a count is an error.

    A list is short (its rank is cut), so one fold over a query's ranked units does
    it; a running sum could not skip.
    """
    counted = hits.join(tokens.select("unit_id", "n_tokens"), "unit_id", "left")
    cost = F.when(F.col("n_tokens").isNull(), F.raise_error(F.concat(F.lit("no token count for unit "), F.col("unit_id").cast("string")))).otherwise(F.col("n_tokens"))
    listed = counted.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", cost.cast("long").alias("n")))).alias("list"))
    unit = dict(hits.dtypes)["unit_id"]
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{unit}>").alias("units"))

    def take(state, item):
        fits = state["used"] + item["n"] <= F.col("budget")
        return F.struct(
            F.when(fits, state["used"] + item["n"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["units"], F.array(item["unit_id"]))).otherwise(state["units"]).alias("units"),
        )

    packed = listed.crossJoin(F.broadcast(budgets.select(F.col("budget").cast("long").alias("budget"))))
    packed = packed.withColumn("taken", F.aggregate("list", empty, take))
    return packed.select("qid", "budget", F.posexplode("taken.units").alias("place", "unit_id"))


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The stand-in tokenizer: words of ASCII letters and digits."""
    n = F.coalesce(F.regexp_count(F.col(text_column), F.lit("[A-Za-z0-9]+")), F.lit(0))
    return docs.select(F.col(id_column).alias("unit_id"), n.cast("long").alias("n_tokens"))
