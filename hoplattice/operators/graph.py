"""Bipartite hops over ``incidence(unit_id, node_id)`` from seed units ``p1(qid, unit_id)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoplattice.operators.ordered import placed
from hoplattice.operators.rank import rounded, top_k
from hoplattice.operators.vector import sampled_dots
from hoplattice.sources.tables import small, stored


def document_frequency(incidence: DataFrame) -> DataFrame:
    """Units of each node; weights of zero, if there are weights, don't count."""
    some = incidence.where("w <> 0") if "w" in incidence.columns else incidence
    return some.groupBy("node_id").agg(F.count("*").alias("df"))


def rarity(n_units: Column | int, df: Column) -> Column:
    """``log1p(N / (1 + df))`` rounded through single precision; always above 0."""
    n = n_units if isinstance(n_units, Column) else F.lit(n_units)
    return F.log1p(n / (1 + df)).cast("float").cast("double")


def weights(incidence: DataFrame) -> DataFrame:
    """``(node_id, df, w)``."""
    n = incidence.select("unit_id").distinct().count()
    return document_frequency(incidence).withColumn("w", rarity(n, F.col("df")))


def node_ids(mentions: DataFrame) -> DataFrame:
    """Dense ids of distinct ``(type, form)`` in order, empty forms left out.

    Forms are dealt into ranges of the whole form; ids are each range's offset plus the place within
    it, so no window runs over all forms, nor over those that begin alike.
    """
    forms = mentions.where("form <> ''").select("type", "form").distinct()
    return placed(forms, F.col("type"), F.col("form")).select(F.col("place").alias("node_id"), "type", "form")


def _scored(seeds: DataFrame, incidence: DataFrame, extra: list[Column]) -> DataFrame:
    return small(seeds).join(incidence, "node_id").groupBy("qid", "unit_id").agg(rounded(F.sum("w")).alias("score"), *extra)


def without_read(scored: DataFrame, read: DataFrame) -> DataFrame:
    """Candidates that are not among the units already read ``(qid, unit_id)``."""
    return scored.join(small(read.select("qid", "unit_id").distinct()), ["qid", "unit_id"], "left_anti").where("score > 0")


def seeds_of(p1: DataFrame, incidence: DataFrame, node_weights: DataFrame, df_cap: int | None = None) -> DataFrame:
    """``(qid, node_id, w)``: the nodes of each query's first unit, those above the cap left out."""
    chosen = node_weights if df_cap is None else node_weights.where(F.col("df") <= df_cap)
    return small(p1).join(incidence, "unit_id").select("qid", "node_id").distinct().join(chosen.select("node_id", "w"), "node_id")


def node_hop(p1: DataFrame, incidence: DataFrame, read: DataFrame | None = None, k: int = 100, df_cap: int | None = None) -> DataFrame:
    """Units that share nodes with the first unit, by the sum of the nodes' rarity; ``positives`` counts them before the cut."""
    seeds = seeds_of(p1, incidence, weights(incidence), df_cap)
    return seeded_hop(seeds, incidence, p1 if read is None else read, k)


def seeded_hop(seeds: DataFrame, incidence: DataFrame, read: DataFrame, k: int = 100) -> DataFrame:
    """The same from an explicit seed set ``(qid, node_id, w)``."""
    scored = without_read(_scored(seeds, incidence, []), read)
    return _counted(scored, k)


def gated_hop(all_nodes: DataFrame, gate: DataFrame, incidence: DataFrame, read: DataFrame, k: int = 100) -> DataFrame:
    """Scored over all of the first unit's nodes; only units that hold a gate node ``(qid, node_id)`` stay."""
    marked = all_nodes.join(gate.select("qid", "node_id", F.lit(1).alias("gate")), ["qid", "node_id"], "left")
    scored = _scored(marked, incidence, [F.max(F.coalesce("gate", F.lit(0))).alias("held")]).where("held = 1").drop("held")
    return _counted(without_read(scored, read), k)


def _counted(scored: DataFrame, k: int) -> DataFrame:
    positives = F.count("*").over(Window.partitionBy("qid"))
    return top_k(scored.withColumn("positives", positives), k)


def concept_hop(p1: DataFrame, x: DataFrame, read: DataFrame | None = None, k: int = 100) -> DataFrame:
    """``sum_c X[v,c] w_c X[p1,c]`` over a weighted matrix ``x(unit_id, node_id, w)``, with the share of units reached."""
    n = x.select("unit_id").distinct().count()
    rare = document_frequency(x).select("node_id", rarity(n, F.col("df")).alias("r"))
    origin = small(p1).join(x, "unit_id").join(rare, "node_id").select("qid", "node_id", (F.col("w") * F.col("r")).alias("a"))
    scored = small(origin).join(x, "node_id").groupBy("qid", "unit_id").agg(rounded(F.sum(F.col("a") * F.col("w"))).alias("score"))
    out = _counted(without_read(scored, p1 if read is None else read), k)
    return out.withColumn("reach", F.col("positives") / F.lit(n))


def candidates(p1: DataFrame, incidence: DataFrame, read: DataFrame, df_cap: int | None = None) -> DataFrame:
    """The whole candidate sets of ``node_hop``, before any cut: ``(qid, unit_id, score)``."""
    return without_read(_scored(seeds_of(p1, incidence, weights(incidence), df_cap), incidence, []), read)


def relevance_hop(candidates: DataFrame, similarity: DataFrame, alphas: DataFrame, k: int = 100) -> DataFrame:
    """``(1 - a) minmax(rarity) + a minmax(similarity)`` over whole candidate sets, at each alpha; at 0 the rarity order itself.

    Ranges are aggregates by query and meet the candidates in a broadcast join where the query set is small; no
    window holds a query's whole candidate set.
    """
    both = stored(candidates.select("qid", "unit_id", "score").join(similarity.select("qid", "unit_id", "sim"), ["qid", "unit_id"]), "candidates")
    ends = both.groupBy("qid").agg(*(f(c).alias(f"{name}_{c}") for c in ("score", "sim") for name, f in (("low", F.min), ("high", F.max))))
    share = lambda c: F.when(F.col(f"high_{c}") > F.col(f"low_{c}"), (F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}"))).otherwise(F.lit(0.0))
    scaled = both.join(small(stored(ends, "ranges")), "qid").select("qid", "unit_id", "score", share("score").alias("a"), share("sim").alias("b"))
    mixed = scaled.crossJoin(F.broadcast(alphas)).withColumn(
        "score", F.when(F.col("alpha") == 0, F.col("score")).otherwise(rounded((1 - F.col("alpha")) * F.col("a") + F.col("alpha") * F.col("b"), 9))
    )
    return top_k(mixed.select("alpha", "qid", "unit_id", "score"), k, ("alpha", "qid"))


def relevance_stage(
    first: DataFrame, incidence: DataFrame, queries: DataFrame, units: DataFrame, alphas: DataFrame, read_depth: int = 10, k: int = 100
) -> DataFrame:
    """The relevance hop from a list: candidates share nodes with its first unit, similarity is the inner product with the query's vector.

    ``first(qid, unit_id, rank)``, ``queries(qid, v)``, ``units(unit_id, v)``; what the list holds within
    ``read_depth`` is left out. Products are taken for candidates only, once for all alphas.
    """
    found = stored(candidates(first.where("rank = 1").select("qid", "unit_id"), incidence, first.where(F.col("rank") <= read_depth)), "hop-candidates")
    return relevance_hop(found, sampled_dots(found, queries, units), alphas, k)


def contributions(seeds: DataFrame, incidence: DataFrame, hits: DataFrame) -> DataFrame:
    """Shared nodes of each hit, heaviest first."""
    shared = small(seeds).join(incidence, "node_id").join(hits.select("qid", "unit_id"), ["qid", "unit_id"], "left_semi")
    order = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("m"), F.col("node_id"))))
    return shared.groupBy("qid", "unit_id").agg(F.transform(order, lambda s: s["node_id"]).alias("nodes"))


def fragmentation(incidence: DataFrame) -> DataFrame:
    """One row: distinct nodes, share held by one unit, and mean, median and maximum per side."""
    per_node = incidence.groupBy("node_id").agg(F.count("*").alias("d")).agg(
        F.count("*").alias("n_nodes"), F.avg((F.col("d") == 1).cast("double")).alias("singleton_share"),
        F.avg("d").alias("units_mean"), F.percentile("d", 0.5).alias("units_median"), F.max("d").alias("units_max"),
    )
    per_unit = incidence.groupBy("unit_id").agg(F.count("*").alias("d")).agg(
        F.count("*").alias("n_units"), F.avg("d").alias("nodes_mean"), F.percentile("d", 0.5).alias("nodes_median"), F.max("d").alias("nodes_max")
    )
    return per_node.crossJoin(per_unit)


def df_statistics(incidence: DataFrame) -> DataFrame:
    """One row: percentiles and maximum of document frequency."""
    cut = {f"p{p}": F.percentile("df", p / 100) for p in (50, 90, 95, 99)}
    return document_frequency(incidence).agg(*(c.alias(n) for n, c in cut.items()), F.max("df").alias("df_max"))


def hubs(incidence: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` nodes with the most units."""
    return document_frequency(incidence).orderBy(F.desc("df"), "node_id").limit(n)
