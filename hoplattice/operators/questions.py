"""Question sets from raw rows: gold by title, cohorts, counts and a stop state; conformance of a source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.operators.corpus import resolve_titles
from hoplattice.sources.tables import small, stored

HISTORICAL, UNSEEN, STOP = "historical-overlap", "retrieval-unseen", "DATA_STOP"


def build(raws: DataFrame, units: DataFrame, historical: DataFrame, expected: int | None = 2) -> DataFrame:
    """``(qid, cohort, position, title, unit_id, how)``: each question's supporting titles, in order, with their units.

    ``raws(qid, titles array<string>)``, ``units(unit_id, title)``, ``historical(qid)``. A title that no unit or several have keeps its
    place in the denominators as ``unresolved:<qid>:<position>``, an id no unit carries. A question that comes twice, or with another number
    of titles than expected, is an error; so is a historical question that is not in the set.
    """
    raws = stored(raws.select("qid", "titles"), "raw-questions")
    n = F.size("titles")
    bad = raws.groupBy("qid").agg(F.count("*").alias("rows"), F.max(n).alias("n")).where("rows > 1" if expected is None else f"rows > 1 OR n <> {int(expected)}").select("qid").first()
    if bad:
        raise ValueError(f"question {bad['qid']} comes twice or with another number of titles")
    lost = historical.select("qid").distinct().join(raws.select("qid"), "qid", "left_anti").select("qid").first()
    if lost:
        raise ValueError(f"historical question {lost['qid']} is not in the set")
    titles = raws.select("qid", F.posexplode("titles").alias("position", "title"))
    found = resolve_titles(titles.select("title"), units).select("title", F.col("unit_id").cast("string").alias("unit_id"), "how")
    sentinel = F.concat_ws(":", F.lit("unresolved"), F.col("qid").cast("string"), F.col("position").cast("string"))
    known = historical.select("qid", F.lit(1).alias("old")).distinct()
    cohort = F.when(F.col("old").isNull(), UNSEEN).otherwise(HISTORICAL)
    return titles.join(found, "title").join(small(known), "qid", "left").select("qid", cohort.alias("cohort"), "position", "title", F.coalesce("unit_id", sentinel).alias("unit_id"), "how")


def body(gold: DataFrame, ceiling: int) -> DataFrame:
    """One row over a built set: questions by cohort, titles by how they were found, questions with an unresolved title, and the stop state.

    ``state`` is ``DATA_STOP`` if more questions than ``ceiling`` are affected, else null.
    """
    lost = ~F.col("how").isin("exact", "normalized")
    per_question = gold.groupBy("qid").agg(F.max("cohort").alias("cohort"), F.sum(lost.cast("long")).alias("lost"), F.sum((F.col("how") == "unmatched").cast("long")).alias("unmatched"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    questions = per_question.agg(
        F.count("*").alias("questions"), count(F.col("cohort") == HISTORICAL).alias("historical"), count(F.col("cohort") == UNSEEN).alias("unseen"),
        count(F.col("lost") > 0).alias("affected"), F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched_gold"), F.coalesce(F.sum(F.col("lost") - F.col("unmatched")), F.lit(0)).alias("ambiguous_gold"),
    )
    titles = gold.select("title", "how").distinct().agg(F.count("*").alias("titles"), *(count(F.col("how") == h).alias(h) for h in ("exact", "normalized", "unmatched", "ambiguous")))
    # one row beside one row
    return questions.crossJoin(titles).withColumn("state", F.when(F.col("affected") > ceiling, STOP))


def conformance(rows: DataFrame, expected: Mapping[str, int], supporting: Mapping[int, int]) -> DataFrame:
    """``(check, found, expected)`` of every way a parsed source differs from the one that was examined; a sound source has none.

    ``rows(part, qid, answerable, supporting)``: ``expected`` is the number of rows of each part; all rows must be answerable, ids unique, and
    questions with each number of supporting passages as many as ``supporting`` says. Parts or numbers nobody expects are reported as well.
    """
    spark = rows.sparkSession
    declared = [(f"rows of {p}", n) for p, n in expected.items()] + [(f"questions with {k} supporting", n) for k, n in supporting.items()] + [("not answerable", 0), ("repeated ids", 0)]
    want = spark.createDataFrame(declared, "check string, expected long")
    long = lambda df: df.select("check", F.col("found").cast("long").alias("found"))
    parts = rows.groupBy(F.concat(F.lit("rows of "), "part").alias("check")).agg(F.count("*").alias("found"))
    sizes = rows.groupBy(F.concat(F.lit("questions with "), F.col("supporting").cast("string"), F.lit(" supporting")).alias("check")).agg(F.count("*").alias("found"))
    closed = rows.agg(F.sum((~F.coalesce("answerable", F.lit(False))).cast("long")).alias("found")).select(F.lit("not answerable").alias("check"), "found")
    twice = rows.groupBy("qid").agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("found")).select(F.lit("repeated ids").alias("check"), "found")
    found = long(parts).unionByName(long(sizes)).unionByName(long(closed)).unionByName(long(twice))
    both = found.join(want, "check", "full").select("check", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("found <> expected")
