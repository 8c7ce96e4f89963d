"""Corpus engineering: pooling, splitting, reconciling and locating."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hoplattice.functions.text import collapsed, content_id, paragraphs, salted_order_key
from hoplattice.sources.tables import small, stored


def pooled(units: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """One row per content id; equal content has equal rows, so any of them will do."""
    keyed = units.select(content_id(F.col(title), F.col(text)).alias("unit_id"), F.col(title).alias("title"), F.col(text).alias("text"))
    return keyed.groupBy("unit_id").agg(F.first("title").alias("title"), F.first("text").alias("text"), F.count("*").alias("copies"))


def first_occurrence(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def ordered_prefix(units: DataFrame, n: int, title: str = "title", text: str = "text") -> DataFrame:
    """The first ``n`` units in salted hash order: corpora of growing ``n`` are nested."""
    keyed = units.withColumn("order_key", salted_order_key(F.col(title), F.col(text)))
    return keyed.orderBy("order_key", *(c for c in units.columns if c.endswith("_id"))).limit(n)


def near_duplicate_groups(units: DataFrame, title: str = "title", text: str = "text", prefix: int = 80) -> DataFrame:
    """Units that share title and the first characters of the text, by group size."""
    keyed = units.groupBy(F.col(title).alias("title"), F.substring(text, 1, prefix).alias("opening")).agg(F.count("*").alias("units"))
    return keyed.where("units > 1")


def resolve_titles(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(title, unit_id, how)``: exact title, else the only one of that normal form; ambiguous or unmatched otherwise.

    Both sides are reduced to a row per title and per normal form before they meet.
    """
    normal = lambda c: F.lower(collapsed(F.col(c)))
    exact = corpus.groupBy("title").agg(F.min("unit_id").alias("exact_id"), F.count("*").alias("exact_n"))
    loose = corpus.groupBy(normal("title").alias("normal")).agg(F.min("unit_id").alias("loose_id"), F.count("*").alias("loose_n"))
    asked = wanted.select("title").distinct().withColumn("normal", normal("title"))
    both = asked.join(exact, "title", "left").join(loose, "normal", "left")
    how = (
        F.when(F.col("exact_n") == 1, "exact").when(F.col("exact_n") > 1, "ambiguous").when(F.col("loose_n") == 1, "normalized").when(F.col("loose_n") > 1, "ambiguous").otherwise("unmatched")
    )
    unit = F.when(how == "exact", F.col("exact_id")).when(how == "normalized", F.col("loose_id"))
    return both.select("title", unit.alias("unit_id"), how.alias("how"))


def resolve_gold(facts: DataFrame, contexts: DataFrame, expected: int | None = 2) -> DataFrame:
    """Gold units of each question by title among its own contexts; a miss, or another number than expected, is an error."""
    joined = facts.select("qid", "title").distinct().join(contexts, ["qid", "title"], "left")
    miss = F.raise_error(F.concat(F.lit("no context titled "), F.col("title"), F.lit(" in question "), F.col("qid").cast("string")))
    gold = joined.select("qid", F.when(F.col("unit_id").isNull(), miss).otherwise(F.col("unit_id")).alias("unit_id")).distinct()
    if expected is None:
        return gold
    n = F.count("*").over(Window.partitionBy("qid"))
    wrong = F.raise_error(F.concat(F.lit("wrong number of gold units in question "), F.col("qid").cast("string")))
    return gold.withColumn("unit_id", F.when(n != expected, wrong).otherwise(F.col("unit_id")))


def reconcile(units: DataFrame, official: DataFrame) -> DataFrame:
    """``(unit_id, official_id, how)``: equal title and text, else equal normal forms; one to one, anything else is ambiguous."""
    normal = lambda c: F.lower(collapsed(F.col(c)))
    exact = units.join(official.withColumnRenamed("unit_id", "official_id"), ["title", "text"]).select("unit_id", "official_id", F.lit("exact").alias("how"))
    left = units.join(exact.select("unit_id"), "unit_id", "left_anti").select("unit_id", normal("title").alias("t"), collapsed(F.col("text")).alias("x"))
    right = official.select(F.col("unit_id").alias("official_id"), normal("title").alias("t"), collapsed(F.col("text")).alias("x"))
    loose = left.join(right, ["t", "x"]).select("unit_id", "official_id", F.lit("normalized").alias("how"))
    both = exact.unionByName(loose)
    by_unit = both.groupBy("unit_id").agg(F.count("*").alias("of_unit"))
    by_official = both.groupBy("official_id").agg(F.count("*").alias("of_official"))
    clear = (F.col("of_unit") == 1) & (F.col("of_official") == 1)
    return both.join(by_unit, "unit_id").join(by_official, "official_id").select("unit_id", "official_id", F.when(clear, F.col("how")).otherwise("ambiguous").alias("how"))


def excluded(records: DataFrame, unresolved: DataFrame, mapped: DataFrame) -> DataFrame:
    """Records left after those whose normal title is unresolved, or whose id is mapped already, are dropped."""
    normal = F.lower(collapsed(F.col("title")))
    out = records.withColumn("_t", normal).join(small(unresolved.select(normal.alias("_t")).distinct()), "_t", "left_anti")
    return out.join(mapped.select("unit_id").distinct(), "unit_id", "left_anti").drop("_t")


#: Characters of a passage that are hashed to find it.
ANCHOR = 24
#: Needles that are broadcast together.
NEEDLES = 4_096


def holders(needles: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(needle_id, needle, doc_id)``: the texts that hold each needle ``(needle_id, needle)``, as they stand.

    Needles are keyed by a hash of their first ``ANCHOR`` characters. Each worker finds
    the anchors of a block of needles in its texts with one pass of an automaton, and
    compares the whole needle only where its anchor stands, so no text meets needles
    that it doesn't share a beginning with. Empty and null needles are nowhere.
    """
    spark = docs.sparkSession
    asked = needles.where(F.length("needle") > 0).select("needle_id", "needle").toLocalIterator()
    schema = f"needle_id {dict(needles.dtypes)['needle_id']}, needle string, {id_column} {dict(docs.dtypes)[id_column]}"
    out = spark.createDataFrame([], schema)
    while block := list(islice(asked, NEEDLES)):
        by_anchor: dict[str, list[tuple]] = {}
        for r in block:
            by_anchor.setdefault(r["needle"][:ANCHOR], []).append((r["needle_id"], r["needle"]))
        shared = spark.sparkContext.broadcast(by_anchor)

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = ahocorasick.Automaton()
            for anchor in shared.value:
                finder.add_word(anchor, anchor)
            finder.make_automaton()
            for batch in batches:
                rows: list[tuple] = []
                for own, text in zip(batch.column(id_column).to_pylist(), batch.column(text_column).to_pylist(), strict=True):
                    near = {anchor for _, anchor in finder.iter(text)} if text else ()
                    rows += [(i, needle, own) for anchor in near for i, needle in shared.value[anchor] if needle in text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow
                )

        arrow = to_arrow_schema(out.schema)
        out = out.unionByName(docs.select(id_column, text_column).mapInArrow(found, out.schema))
    return out


def located_facts(facts: DataFrame, docs: DataFrame, id_column: str = "doc_id", body_column: str = "text") -> DataFrame:
    """``(id, fact_id, start, position, touched)``: where each fact first stands in each body that holds it.

    ``facts(fact_id, fact)`` is a query set, broadcast in blocks.
    ``position`` is the paragraph that holds the fact's first character that isn't
    white space, ``touched`` the paragraphs that its span meets.
    """
    asked = facts.where(F.trim("fact") != "").select(F.col("fact_id").alias("needle_id"), F.col("fact").alias("needle"))
    matched = stored(holders(asked, docs, id_column, body_column).select(F.col(id_column).alias("id"), F.col("needle_id").alias("fact_id"), F.col("needle").alias("fact")), "facts")
    found = docs.select(F.col(id_column).alias("id"), F.col(body_column).alias("body")).join(matched, "id")
    lead = F.length("fact") - F.length(F.ltrim("fact"))
    spans = found.select("id", "fact_id", (F.instr("body", F.col("fact")) - 1).alias("start"), F.length("fact").alias("n"), lead.alias("lead"))
    held = docs.join(spans.select(F.col("id").alias(id_column)).distinct(), id_column, "left_semi")
    parts = paragraphs(held, id_column, body_column).withColumnsRenamed({"start": "p_start", "end": "p_end"})
    met = spans.join(parts, "id").where((F.col("p_start") < F.col("start") + F.col("n")) & (F.col("p_end") > F.col("start")))
    first = F.col("start") + F.col("lead")
    holder = F.max(F.when((F.col("p_start") <= first) & (first < F.col("p_end")), F.col("position")))
    return met.groupBy("id", "fact_id", "start").agg(holder.alias("position"), F.count("*").alias("touched"))


def cohorts(questions: DataFrame, historical: DataFrame) -> DataFrame:
    """``(qid, cohort)``: every question in ``standard``, and in ``historical`` or ``unseen``."""
    known = historical.select("qid", F.lit(1).alias("_k")).distinct()
    both = questions.select("qid").distinct().join(known, "qid", "left")
    own = F.when(F.col("_k") == 1, "historical").otherwise("unseen")
    return both.select("qid", F.explode(F.array(F.lit("standard"), own)).alias("cohort"))


def shards(units: DataFrame, size: int, key: str = "unit_id") -> DataFrame:
    """``(shard, first, last, n)`` of runs of ``size`` rows in key order.

    Places come from range buckets and their offsets, not from one window over all rows.
    """
    bounds = units.select(F.percentile_approx(key, [k / 64 for k in range(1, 64)])).first()[0] or []
    bucket = F.size(F.filter(F.array(*(F.lit(b) for b in sorted(set(bounds)))), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    dealt = units.select(key, bucket.alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(key)) + F.col("before") - 1
    numbered = dealt.join(F.broadcast(offsets), "bucket").withColumn("shard", F.floor(place / size))
    return numbered.groupBy("shard").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def token_coverage(units: DataFrame, *counts: DataFrame) -> DataFrame:
    """One row: units without a count, and units that more than one table counts."""
    seen = counts[0].select("unit_id")
    for more in counts[1:]:
        seen = seen.unionByName(more.select("unit_id"))
    per_unit = seen.groupBy("unit_id").agg(F.count("*").alias("n"))
    both = units.select("unit_id").distinct().join(per_unit, "unit_id", "left")
    return both.agg(F.sum(F.col("n").isNull().cast("int")).alias("missing"), F.sum((F.coalesce("n", F.lit(0)) > 1).cast("int")).alias("doubled"))
