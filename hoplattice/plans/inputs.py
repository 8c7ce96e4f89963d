"""The domain's roles over the data tables: units, questions, gold, lists, incidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplattice.operators import corpus, fusion, graph, lexical, metrics, pack, vector
from hoplattice.operators.rank import top_k
from hoplattice.sources.tables import small, stored, table

COMPONENTS = ["bm25", "overlap", "hop"]
WEIGHTS = {"bm25": 0.5, "overlap": 0.3, "hop": 0.2}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage, whole, as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the passage, found by the passages' first words and then compared; stored, as many steps read it."""
    asked = questions(spark, sf_dir).withColumnRenamed("query", "needle")
    held = corpus.holders(asked.withColumnRenamed("qid", "needle_id"), table(spark, sf_dir, "documents"))
    return stored(held.select(F.col("needle_id").alias("qid"), F.col("doc_id").alias("unit_id")).distinct(), "qrels")


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, as hops, pools and contexts read the same list."""
    return stored(lexical.bm25(questions(spark, sf_dir), table(spark, sf_dir, "documents")), "bm25")


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.overlap(questions(spark, sf_dir), table(spark, sf_dir, "documents"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of documents as nodes."""
    docs = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})")))
    return docs.select(F.col("doc_id").alias("unit_id"), F.explode(words).alias("node_id")).distinct()


def entity_hop(spark: SparkSession, sf_dir: str, first: DataFrame) -> DataFrame:
    """Documents that share capitalised words with the list's first unit, those among its first ten left out."""
    p1, read = first.where("rank = 1").select("qid", "unit_id"), first.where("rank <= 10")
    return graph.node_hop(p1, stored(entities(spark, sf_dir), "entities"), read)


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25, overlap and entity hop of every question."""
    first = bm25(spark, sf_dir)
    return stored(fusion.components(bm25=first, overlap=overlap(spark, sf_dir), hop=entity_hop(spark, sf_dir, first)), "lists")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.token_counts(table(spark, sf_dir, "documents"))


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in metrics.BUDGETS], "budget long")


def contexts(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    hits = stored(hits, "hits")
    units = hits.select("unit_id").distinct()
    return pack.fill_contexts(hits, tokens(spark, sf_dir).join(small(units), "unit_id", "left_semi"), budgets(spark))


def outcomes(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    return metrics.context_metrics(questions(spark, sf_dir), contexts(spark, sf_dir, hits), qrels(spark, sf_dir), budgets(spark))


def orders_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units, parts as nodes."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").alias("node_id")).distinct()


def order_queries(incidence: DataFrame) -> DataFrame:
    """The query set: every order whose key is divisible by 100, as its own first unit."""
    return incidence.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "unit_id").distinct()


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts, weighted by the quantity supplied."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id"), F.col("l_partkey").alias("node_id")).agg(F.sum("l_quantity").alias("w"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("v"), "label")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense list of every vector whose id is divisible by 100, against all others."""
    units = vectors(spark, sf_dir)
    return vector.dense_topk(units.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "v"), units)


def first_of(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits.select("qid", "unit_id", "score"), k)
