"""Queries: lists, fusions, contexts, metrics and comparisons over documents and benchmark passages, and dense lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplattice.operators import fusion, graph, grids, metrics, paired, product, rank, rerank, seeds, vector
from hoplattice.plans import fragments as sql
from hoplattice.plans import inputs
from hoplattice.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    """Registers a query and the SQL that checks it."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


@query("r2_bm25_topk", f"WITH {sql.BM25} SELECT qid, unit_id, score, rank FROM bm25")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.bm25(spark, sf_dir).select("qid", "unit_id", "score", "rank")


@query("r6_rarity_overlap", f"WITH {sql.BM25} {sql.OVERLAP} SELECT qid, unit_id, score, rank FROM shared")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.overlap(spark, sf_dir).select("qid", "unit_id", "score", "rank")


@query("h11_entity_hop", f"WITH {sql.BM25} {sql.ENTITIES} SELECT qid, unit_id, score, positives, rank FROM hop")
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.entity_hop(spark, sf_dir, inputs.bm25(spark, sf_dir)).select("qid", "unit_id", "score", "positives", "rank")


@query("h1_continue_list", f"WITH {sql.BM25} SELECT qid, unit_id, score, rank FROM bm25 WHERE rank > 10 AND rank <= 60")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.bm25(spark, sf_dir).where("rank > 10 and rank <= 60").select("qid", "unit_id", "score", "rank")


@query("u1_union_of_lists", f"WITH {sql.LISTS} SELECT DISTINCT qid, unit_id FROM lists")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.union_of(inputs.lists(spark, sf_dir))


@query("w1_rank_within_component", f"WITH {sql.LISTS} SELECT component, qid, unit_id, place AS rank FROM scaled")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.with_rank(inputs.lists(spark, sf_dir), ("component", "qid")).select("component", "qid", "unit_id", "rank")


@query("w2_min_max", f"WITH {sql.LISTS} SELECT component, qid, unit_id, round(norm, 6) AS norm FROM scaled")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = rank.min_max(inputs.lists(spark, sf_dir), ("component", "qid"))
    return scaled.select("component", "qid", "unit_id", F.round("norm", 6).alias("norm"))


@query("f1_weighted_fusion", f"WITH {sql.LISTS} SELECT qid, unit_id, score, rank FROM fused")
@query("f4_triple_fusion", f"WITH {sql.LISTS} SELECT qid, unit_id, score, rank FROM fused")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted(inputs.lists(spark, sf_dir), inputs.WEIGHTS)


@query("f2_rrf", f"WITH {sql.LISTS} SELECT qid, unit_id, score, rank FROM rrf")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(inputs.lists(spark, sf_dir))


_TWO = f"""WITH {sql.LISTS}, two AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT qid, unit_id, round(sum(norm * CASE component WHEN 'bm25' THEN 0.6 ELSE 0.4 END), 6) AS score FROM scaled WHERE component <> 'hop' GROUP BY qid, unit_id) QUALIFY rank <= 100)"""


@query("f3_hybrid_pair", _TWO + " SELECT qid, unit_id, score, rank FROM two")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fusion.components(bm25=inputs.bm25(spark, sf_dir), overlap=inputs.overlap(spark, sf_dir))
    return fusion.weighted(both, {"bm25": 0.6, "overlap": 0.4})


_GRID_POINTS = ", ".join(f"({k}, {p['bm25']}, {p['overlap']}, {p['hop']})" for k, p in enumerate(grids.simplex(inputs.COMPONENTS)))
_GRID = f"""WITH {sql.LISTS} {sql.GOLD}, points(point, a, b, c) AS (VALUES {_GRID_POINTS}),
wide AS (SELECT qid, unit_id, coalesce(max(norm) FILTER (component = 'bm25'), 0.0) AS na, coalesce(max(norm) FILTER (component = 'overlap'), 0.0) AS nb, coalesce(max(norm) FILTER (component = 'hop'), 0.0) AS nc FROM scaled GROUP BY qid, unit_id),
ranked AS (SELECT point, qid, unit_id, row_number() OVER (PARTITION BY point, qid ORDER BY round(a * na + b * nb + c * nc, 6) DESC, unit_id) AS rank FROM wide, points QUALIFY rank <= 10),
per_point AS (SELECT point, count(*) AS found FROM ranked JOIN qrels USING (qid, unit_id) GROUP BY point)
SELECT points.point, CAST(a AS DOUBLE) AS w_bm25, CAST(b AS DOUBLE) AS w_overlap, CAST(c AS DOUBLE) AS w_hop, coalesce(found, 0) AS found FROM points LEFT JOIN per_point USING (point)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = grids.weight_table(spark, inputs.COMPONENTS)
    fused = product.topk(inputs.lists(spark, sf_dir), inputs.COMPONENTS, product.weights_of(inputs.COMPONENTS), k=10)
    found = fused.join(inputs.qrels(spark, sf_dir), ["qid", "unit_id"]).groupBy("point").agg(F.count("*").alias("found"))
    return points.join(found, "point", "left").select("point", "w_bm25", "w_overlap", "w_hop", F.coalesce("found", F.lit(0)).alias("found"))


@query("x4_triple_weight_grid", _GRID)
@query("f8_grid_fusion", _GRID)
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query("t14_grid_choice", f"SELECT * FROM ({_GRID}) ORDER BY found DESC, w_bm25 DESC, w_overlap DESC LIMIT 1")
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.choose(_grid(spark, sf_dir), F.desc("found"), F.desc("w_bm25"), F.desc("w_overlap"))


@query("t10_contenders", f"SELECT point, found FROM ({_GRID}) QUALIFY found >= max(found) OVER () - 1")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.contenders(_grid(spark, sf_dir), "found", 1).select("point", "found")


@query("w10_order_check", f"WITH {sql.BM25} SELECT qid, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS repeated, count(*) AS n FROM bm25 GROUP BY qid")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.order_problems(inputs.bm25(spark, sf_dir))


_PACK = f"WITH RECURSIVE {sql.LISTS} {sql.GOLD} {sql.packed('ctx', 'fused')} {sql.outcomes('out', 'ctx')}"
_BOTH = f"{_PACK} {sql.packed('ctx_b', 'bm25')} {sql.outcomes('out_b', 'ctx_b')}"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted(inputs.lists(spark, sf_dir), inputs.WEIGHTS)


@query("w3_budget_pack", _PACK + " SELECT qid, budget, place, unit_id FROM ctx")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.contexts(spark, sf_dir, _fused(spark, sf_dir)).select("qid", "budget", "place", "unit_id")


@query("m1_context_metrics", _PACK + " SELECT qid, budget, units, round(gold_recall, 9) AS gold_recall, full_support, round(context_precision, 9) AS context_precision FROM out")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inputs.outcomes(spark, sf_dir, _fused(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("gold_recall", "context_precision")})


@query("m6_harness_means", _PACK + " SELECT budget, round(avg(gold_recall), 9) AS gold_recall, round(avg(full_support), 9) AS full_support, round(avg(context_precision), 9) AS context_precision, round(avg(units), 9) AS units, count(*) AS questions, sum(full_support) AS supported FROM out GROUP BY budget")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.budget_means(inputs.outcomes(spark, sf_dir, _fused(spark, sf_dir)))


_RANK_METRICS = f"""WITH {sql.LISTS} {sql.GOLD}, f AS (SELECT qid, coalesce(count(*) FILTER (rank <= 2), 0) AS f2, count(*) FILTER (rank <= 5) AS f5, count(*) FILTER (rank <= 10) AS f10, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM fused JOIN qrels USING (qid, unit_id) GROUP BY qid),
g AS (SELECT qid, n_gold, coalesce(f2, 0) AS f2, coalesce(f5, 0) AS f5, coalesce(f10, 0) AS f10, coalesce(dcg, 0) AS dcg, (SELECT sum(1 / log2(r + 1)) FROM range(1, 1 + CAST(least(greatest(n_gold, 1), 10) AS BIGINT)) t(r)) AS ideal FROM gold LEFT JOIN f USING (qid))
SELECT qid, n_gold, CASE WHEN n_gold > 0 THEN f2 / n_gold ELSE 0.0 END AS recall_2, CASE WHEN n_gold > 0 THEN f5 / n_gold ELSE 0.0 END AS recall_5, CASE WHEN n_gold > 0 THEN f10 / n_gold ELSE 0.0 END AS recall_10,
CAST(n_gold > 0 AND f2 = n_gold AS INTEGER) AS support_2, CAST(n_gold > 0 AND f5 = n_gold AS INTEGER) AS support_5, CAST(n_gold > 0 AND f10 = n_gold AS INTEGER) AS support_10, CASE WHEN n_gold > 0 THEN round(dcg / ideal, 9) ELSE 0.0 END AS ndcg FROM g"""


@query("m5_ndcg_recall_at_k", _RANK_METRICS)
@query("m7_full_support_at_k", f"SELECT qid, support_2, support_5, support_10 FROM ({_RANK_METRICS})")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_metrics(inputs.questions(spark, sf_dir), _fused(spark, sf_dir), inputs.qrels(spark, sf_dir))


QUERIES["m7_full_support_at_k"] = lambda spark, sf_dir: m5(spark, sf_dir).select("qid", "support_2", "support_5", "support_10")


@query("a16_hits_at_k", f"WITH {sql.LISTS} {sql.GOLD} SELECT count(*) AS gold, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) AS hits_1, round(avg(CASE WHEN rank <= 2 THEN 1.0 ELSE 0 END), 9) AS hits_2, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 9) AS hits_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 9) AS hits_10 FROM qrels LEFT JOIN fused USING (qid, unit_id)")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hits_at(_fused(spark, sf_dir), inputs.qrels(spark, sf_dir))


@query("q10_reach", f"WITH {sql.LISTS} {sql.GOLD} SELECT count(*) AS outside, count(hop.unit_id) AS listed, count(DISTINCT qid) AS questions FROM qrels LEFT JOIN hop USING (qid, unit_id) WHERE (qid, qrels.unit_id) NOT IN (SELECT qid, unit_id FROM bm25 WHERE rank <= 10)")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = inputs.bm25(spark, sf_dir)
    return metrics.reach(inputs.entity_hop(spark, sf_dir, first), inputs.qrels(spark, sf_dir), first.where("rank <= 10"))


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.outcomes(spark, sf_dir, _fused(spark, sf_dir)).where("budget = 512")
    b = inputs.outcomes(spark, sf_dir, inputs.bm25(spark, sf_dir)).where("budget = 512")
    return paired.paired_table(a, b)


_CROSS = _BOTH + " SELECT count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither, count(*) AS n FROM (SELECT out.full_support AS a, out_b.full_support AS b FROM out JOIN out_b USING (qid, budget) WHERE budget = 512)"


@query("j14_paired_counts", _CROSS)
@query("u8_cross_table", _CROSS)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.cross_table(_pair(spark, sf_dir))


@query("t1_mcnemar", f"SELECT only_a, only_b, n, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM range(0, least(only_a, only_b) + 1) t(i))), 9) END AS p FROM ({_CROSS})")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.compared(paired.cross_table(_pair(spark, sf_dir))).select("only_a", "only_b", "n", "p")


@query("t3_paired_tests")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tests, Tango's interval and the label; roots and big integers are beyond SQL and are tested by hand-worked values."""
    return paired.compared(paired.cross_table(_pair(spark, sf_dir)))


@query("u9_coverage_changes", _BOTH + " SELECT qid, count(*) FILTER (x AND NOT y) AS gained, count(*) FILTER (y AND NOT x) AS lost FROM (SELECT qid, (qid, unit_id) IN (SELECT qid, unit_id FROM ctx WHERE budget = 2048) AS x, (qid, unit_id) IN (SELECT qid, unit_id FROM ctx_b WHERE budget = 2048) AS y FROM qrels) GROUP BY qid")
def u9(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.contexts(spark, sf_dir, inputs.bm25(spark, sf_dir)).where("budget = 2048")
    b = inputs.contexts(spark, sf_dir, _fused(spark, sf_dir)).where("budget = 2048")
    return paired.coverage_changes(a, b, inputs.qrels(spark, sf_dir))


@query("a20_ladder", _BOTH + " SELECT 'bm25' AS system, 1 AS rung, sum(full_support) AS supported, round(avg(gold_recall), 9) AS gold_recall, CAST(NULL AS BIGINT) AS gain FROM out_b WHERE budget = 512 UNION ALL SELECT 'fused', 2, sum(full_support), round(avg(gold_recall), 9), sum(full_support) - (SELECT sum(full_support) FROM out_b WHERE budget = 512) FROM out WHERE budget = 512")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.outcomes(spark, sf_dir, inputs.bm25(spark, sf_dir)).where("budget = 512").withColumn("system", F.lit("bm25"))
    b = inputs.outcomes(spark, sf_dir, _fused(spark, sf_dir)).where("budget = 512").withColumn("system", F.lit("fused"))
    return paired.ladder(a.unionByName(b), ["bm25", "fused"])


@query("a21_difference_histogram", _BOTH + " SELECT round(out.gold_recall - out_b.gold_recall, 6) AS difference, count(*) AS questions FROM out JOIN out_b USING (qid, budget) WHERE budget = 512 GROUP BY 1")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.outcomes(spark, sf_dir, inputs.bm25(spark, sf_dir)).where("budget = 512")
    return paired.differences(a, inputs.outcomes(spark, sf_dir, _fused(spark, sf_dir)).where("budget = 512"))


@query("a13_grouped_summary", _PACK + " SELECT CASE WHEN n_gold = 0 THEN 'none' WHEN n_gold = 1 THEN 'one' ELSE 'several' END AS \"group\", count(*) AS questions, sum(full_support) AS supported, round(avg(gold_recall), 9) AS gold_recall FROM out JOIN gold USING (qid) WHERE budget = 2048 GROUP BY 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inputs.outcomes(spark, sf_dir, _fused(spark, sf_dir)).where("budget = 2048")
    counts = metrics.gold_counts(inputs.questions(spark, sf_dir), inputs.qrels(spark, sf_dir))
    group = F.when(F.col("n_gold") == 0, "none").when(F.col("n_gold") == 1, "one").otherwise("several")
    return paired.grouped(out, counts.select("qid", group.alias("group")))


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank.with_rank(inputs.lists(spark, sf_dir), ("component", "qid"))
    return ranked.withColumnRenamed("component", "system")


_POOL = f"{sql.LISTS}, pool AS (SELECT qid, unit_id, best_rank, systems, row_number() OVER (PARTITION BY qid ORDER BY best_rank, unit_id) AS place FROM (SELECT qid, unit_id, min(place) AS best_rank, count(*) AS systems FROM scaled GROUP BY qid, unit_id))"


@query("q1_pool_union", f"WITH {_POOL} SELECT qid, unit_id, best_rank, systems, place FROM pool")
@query("w11_best_rank", f"WITH {_POOL} SELECT qid, unit_id, best_rank FROM pool")
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.pool(_systems(spark, sf_dir)).select("qid", "unit_id", "best_rank", "systems", "place")


QUERIES["w11_best_rank"] = lambda spark, sf_dir: rank.best_rank(_systems(spark, sf_dir))

_JUDGED = f"""{_POOL}, judged AS (SELECT qid, unit_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{{2,}}')), list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]{{2,}}')))) AS DOUBLE) AS judge FROM pool JOIN benchmark b ON item_id = qid JOIN documents d ON doc_id = unit_id)"""


def _judged(spark: SparkSession, sf_dir: str, pooled: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    asked = inputs.questions(spark, sf_dir).withColumnRenamed("query", "question")
    return rerank.judged_by_overlap(pooled.select("qid", "unit_id").join(asked, "qid").join(docs, "unit_id"))


@query("q4_reorder", f"WITH {_JUDGED} SELECT qid, unit_id, judge, row_number() OVER (PARTITION BY qid ORDER BY judge DESC, bm25.rank) AS rank FROM bm25 JOIN judged USING (qid, unit_id)")
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = inputs.bm25(spark, sf_dir)
    return rerank.reorder(first, _judged(spark, sf_dir, first)).select("qid", "unit_id", "judge", "rank")


@query("q5_union_order", f"WITH {_JUDGED} SELECT qid, unit_id, judge, row_number() OVER (PARTITION BY qid ORDER BY judge DESC, best_rank, unit_id) AS rank FROM pool JOIN judged USING (qid, unit_id)")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = rerank.pool(_systems(spark, sf_dir))
    return rerank.union_order(pooled, _judged(spark, sf_dir, pooled)).select("qid", "unit_id", "judge", "rank")


@query("m9_judge_ceiling", f"WITH RECURSIVE {_POOL} {sql.GOLD} {sql.packed('ctx', 'fused')} {sql.outcomes('out', 'ctx')} SELECT count(*) AS questions, sum(inside) AS all_inside, sum(full_support) AS supported, sum(CAST(inside = 1 AND full_support = 0 AS INTEGER)) AS failures_inside FROM (SELECT qid, CAST(count(*) = count(pool.unit_id) AS INTEGER) AS inside FROM qrels LEFT JOIN pool USING (qid, unit_id) GROUP BY qid) JOIN out USING (qid) WHERE budget = 512")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inputs.outcomes(spark, sf_dir, _fused(spark, sf_dir)).where("budget = 512")
    return rerank.ceiling(rerank.pool(_systems(spark, sf_dir)), inputs.qrels(spark, sf_dir), out)


_PACK_RRF = f"WITH RECURSIVE {sql.LISTS} {sql.GOLD} {sql.packed('ctx', 'rrf')} {sql.packed('ctx_b', 'bm25')}"


@query("q8_rank_split", f"{_PACK_RRF}, changed AS (SELECT qid, unit_id, CASE WHEN x THEN 'gained' ELSE 'lost' END AS change FROM (SELECT qid, unit_id, (qid, unit_id) IN (SELECT qid, unit_id FROM ctx WHERE budget = 2048) AS x, (qid, unit_id) IN (SELECT qid, unit_id FROM ctx_b WHERE budget = 2048) AS y FROM qrels) WHERE x <> y) SELECT change, CASE WHEN rank <= 10 THEN '1-10' WHEN rank <= 100 THEN '11-100' ELSE 'beyond-100' END AS rank_class, count(*) AS n FROM changed LEFT JOIN bm25 USING (qid, unit_id) GROUP BY ALL")
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold that reciprocal ranks win or lose against BM25 at 2048 tokens, by where BM25 had it."""
    first = inputs.bm25(spark, sf_dir)
    gold = inputs.qrels(spark, sf_dir)
    held = lambda hits, name: inputs.contexts(spark, sf_dir, hits).where("budget = 2048").select("qid", "unit_id", F.lit(1).alias(name))
    both = gold.join(held(fusion.rrf(inputs.lists(spark, sf_dir)), "x"), ["qid", "unit_id"], "left").join(held(first, "y"), ["qid", "unit_id"], "left").fillna(0, ["x", "y"])
    changed = both.where("x <> y").select("qid", "unit_id", F.when(F.col("x") == 1, "gained").otherwise("lost").alias("change"))
    return rerank.rank_split(changed, first)


@query("q11_first_changes", f"WITH {sql.LISTS} SELECT count(*) AS questions, sum(CAST(a.unit_id <> b.unit_id AS INTEGER)) AS changed, round(avg(CAST(a.unit_id <> b.unit_id AS INTEGER)), 9) AS share FROM (SELECT * FROM bm25 WHERE rank = 1) a JOIN (SELECT * FROM shared WHERE rank = 1) b USING (qid)")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.first_changes(inputs.bm25(spark, sf_dir), inputs.overlap(spark, sf_dir))


@query("q7_list_overlap", f"WITH {sql.LISTS} SELECT qid, count(*) AS shared FROM bm25 JOIN shared USING (qid, unit_id) WHERE bm25.rank <= 10 AND shared.rank <= 10 GROUP BY qid")
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.overlap_at(inputs.bm25(spark, sf_dir), inputs.overlap(spark, sf_dir))


@query("r1_dense_topk", f"WITH {sql.DENSE} SELECT qid, unit_id, score, rank FROM dense")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.dense(spark, sf_dir)


@query("m4_dense_label_recall", f"WITH {sql.DENSE}, gold AS (SELECT q.vec_id AS qid, u.vec_id AS unit_id FROM embeddings q JOIN embeddings u ON q.vec_id % 100 = 0 AND q.label = u.label AND q.vec_id <> u.vec_id) SELECT qid, count(*) AS n_gold, count(*) FILTER (rank <= 10) AS found_10, count(rank) AS found_100 FROM gold LEFT JOIN dense USING (qid, unit_id) GROUP BY qid")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is every other vector of the query's label: counted by label, and looked up in the lists, never paired."""
    units = inputs.vectors(spark, sf_dir)
    sizes = units.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    asked = units.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "label").join(sizes, "label")
    own = inputs.dense(spark, sf_dir).join(units.select("unit_id", F.col("label").alias("own")), "unit_id").select("qid", "rank", "own")
    hits = asked.join(own, (asked["qid"] == own["qid"]) & (asked["label"] == own["own"]), "left").select(asked["qid"], "n_gold", "rank")
    return hits.groupBy("qid", "n_gold").agg(F.sum((F.coalesce("rank", F.lit(1000)) <= 10).cast("long")).alias("found_10"), F.count("rank").alias("found_100")).where("n_gold > 0")


@query("h3_dense_neighbours", f"WITH {sql.DENSE}, first AS (SELECT qid, unit_id AS p1 FROM dense WHERE rank = 1), near AS (SELECT qid, u.vec_id AS unit_id, round(list_inner_product(CAST(p.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])), 6) AS score FROM first JOIN embeddings p ON p.vec_id = p1 JOIN embeddings u ON u.vec_id <> qid) SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM near WHERE (qid, unit_id) NOT IN (SELECT qid, unit_id FROM dense WHERE rank <= 10) QUALIFY rank <= 100")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = inputs.dense(spark, sf_dir)
    units = inputs.vectors(spark, sf_dir)
    p1 = first.where("rank = 1").select("qid", "unit_id").join(units, "unit_id").select("qid", "v")
    near = vector.dense_topk(p1, units, 111)
    return rank.top_k(near.join(first.where("rank <= 10").select("qid", "unit_id"), ["qid", "unit_id"], "left_anti").select("qid", "unit_id", "score"), 100)


_QHOP = f"""WITH {sql.LISTS}, q_seeds AS (SELECT DISTINCT item_id AS qid, node_id, w FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) AS node_id FROM benchmark) JOIN node_w USING (node_id)),
qhop AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT qid, unit_id, round(sum(w), 6) AS score FROM q_seeds JOIN incidence USING (node_id) GROUP BY qid, unit_id) WHERE (qid, unit_id) NOT IN (SELECT qid, unit_id FROM bm25 WHERE rank <= 10) QUALIFY rank <= 100)"""


def _question_hop(spark: SparkSession, sf_dir: str, first: DataFrame) -> DataFrame:
    incidence = inputs.entities(spark, sf_dir)
    spans = inputs.questions(spark, sf_dir).select("qid", F.explode(F.regexp_extract_all("query", F.lit("([A-Z][a-z]{3,})"))).alias("form"))
    nodes = incidence.select("node_id", F.col("node_id").alias("form")).distinct()
    return graph.seeded_hop(seeds.from_question(spans, nodes, graph.weights(incidence)), incidence, first.where("rank <= 10"))


@query("h13_question_hop", _QHOP + " SELECT qid, unit_id, score, rank FROM qhop")
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _question_hop(spark, sf_dir, inputs.bm25(spark, sf_dir)).select("qid", "unit_id", "score", "rank")


@query("f6_quad_fusion", _QHOP + """, four AS (SELECT component, qid, unit_id, norm FROM scaled UNION ALL SELECT 'question', qid, unit_id, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 0.0 END FROM qhop WINDOW q AS (PARTITION BY qid))
SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT qid, unit_id, round(sum(norm * CASE component WHEN 'bm25' THEN 0.4 WHEN 'overlap' THEN 0.3 WHEN 'hop' THEN 0.2 ELSE 0.1 END), 6) AS score FROM four GROUP BY qid, unit_id) QUALIFY rank <= 100""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = _question_hop(spark, sf_dir, inputs.bm25(spark, sf_dir))
    four = inputs.lists(spark, sf_dir).unionByName(fusion.components(question=question))
    return fusion.weighted(four, {"bm25": 0.4, "overlap": 0.3, "hop": 0.2, "question": 0.1})
