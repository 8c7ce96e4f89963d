"""Queries: hops, weights and walks over lineitem's orders, parts and suppliers, and concept tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplattice.operators import concepts, graph, walk
from hoplattice.operators.rank import truncate_rows
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


@query("a1_document_frequency", f"WITH {sql.ORDERS} SELECT node_id, df FROM node_w")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.document_frequency(inputs.orders_parts(spark, sf_dir))


@query("a2_rarity_weight", f"WITH {sql.ORDERS} SELECT node_id, df, w FROM node_w")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weights(inputs.orders_parts(spark, sf_dir))


@query("a4_node_ids", "SELECT CAST(row_number() OVER (ORDER BY type, form) - 1 AS BIGINT) AS node_id, type, form FROM (SELECT DISTINCT 'entity' AS type, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS form FROM documents)")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = inputs.entities(spark, sf_dir).select(F.lit("entity").alias("type"), F.col("node_id").alias("form"))
    return graph.node_ids(forms)


@query("a5_fragmentation", f"WITH {sql.ORDERS} SELECT * FROM (SELECT count(*) AS n_nodes, avg(CAST(d = 1 AS INTEGER)) AS singleton_share, avg(d) AS units_mean, quantile_cont(d, 0.5) AS units_median, max(d) AS units_max FROM (SELECT count(*) AS d FROM incidence GROUP BY node_id)), (SELECT count(*) AS n_units, avg(d) AS nodes_mean, quantile_cont(d, 0.5) AS nodes_median, max(d) AS nodes_max FROM (SELECT count(*) AS d FROM incidence GROUP BY unit_id))")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fragmentation(inputs.orders_parts(spark, sf_dir))


@query("a6_df_percentiles", f"WITH {sql.ORDERS} SELECT " + ", ".join(f"quantile_cont(df, {p / 100}) AS p{p}" for p in (50, 90, 95, 99)) + ", max(df) AS df_max FROM node_w")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.df_statistics(inputs.orders_parts(spark, sf_dir))


@query("a6_hubs", f"WITH {sql.ORDERS} SELECT node_id, df FROM node_w ORDER BY df DESC, node_id LIMIT 25")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(inputs.orders_parts(spark, sf_dir))


_HOP = f"WITH {sql.ORDERS} {sql.order_hop('hop', 'seeds')} SELECT qid, unit_id, score, positives, rank FROM hop"


@query("h6_node_hop", _HOP)
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidence = inputs.orders_parts(spark, sf_dir)
    return graph.node_hop(inputs.order_queries(incidence), incidence)


@query("h12_capped_hop", _HOP.replace("FROM seeds JOIN", "FROM (SELECT * FROM seeds WHERE df <= 30) JOIN"))
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidence = inputs.orders_parts(spark, sf_dir)
    return graph.node_hop(inputs.order_queries(incidence), incidence, df_cap=30)


_RAREST = ", rarest AS (SELECT qid, node_id, w FROM seeds QUALIFY row_number() OVER (PARTITION BY qid ORDER BY w DESC, node_id) <= 2)"


def _seeds(incidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    p1 = inputs.order_queries(incidence)
    seeds = graph.seeds_of(p1, incidence, graph.weights(incidence))
    listed = seeds.select("qid", F.col("node_id").alias("unit_id"), F.col("w").alias("score"))
    rarest = inputs.first_of(listed, 2).select("qid", F.col("unit_id").alias("node_id"), F.col("score").alias("w"))
    return p1, seeds, rarest


@query("h7_seeded_hop", f"WITH {sql.ORDERS} {_RAREST} {sql.order_hop('hop', 'rarest')} SELECT qid, unit_id, score, positives, rank FROM hop")
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidence = inputs.orders_parts(spark, sf_dir)
    p1, _, rarest = _seeds(incidence)
    return graph.seeded_hop(rarest, incidence, p1)


@query("w7_rarest_nodes", f"WITH {sql.ORDERS} {_RAREST} SELECT qid, node_id, w FROM rarest")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(inputs.orders_parts(spark, sf_dir))[2]


@query("h8_gated_hop", f"WITH {sql.ORDERS} {_RAREST} {sql.order_hop('hop', '(SELECT s.qid, s.node_id, s.w, r.node_id IS NOT NULL AS g FROM seeds s LEFT JOIN rarest r USING (qid, node_id))', 'bool_or(g)')} SELECT qid, unit_id, score, positives, rank FROM hop")
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidence = inputs.orders_parts(spark, sf_dir)
    p1, seeds, rarest = _seeds(incidence)
    return graph.gated_hop(seeds, rarest, incidence, p1)


@query("h10_contributions", f"WITH {sql.ORDERS} {sql.order_hop('hop', 'seeds')} SELECT qid, unit_id, list(node_id ORDER BY w DESC, node_id) AS nodes FROM hop JOIN seeds USING (qid) JOIN incidence USING (unit_id, node_id) WHERE rank <= 10 GROUP BY qid, unit_id")
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidence = inputs.orders_parts(spark, sf_dir)
    p1, seeds, _ = _seeds(incidence)
    return graph.contributions(seeds, incidence, graph.seeded_hop(seeds, incidence, p1, 10))


_RELEVANCE = f"""WITH {sql.ORDERS}, cand AS (SELECT qid, unit_id, round(sum(w), 6) AS score FROM seeds JOIN incidence USING (node_id) GROUP BY qid, unit_id HAVING qid <> unit_id),
size AS (SELECT l_orderkey AS unit_id, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
both_ AS (SELECT qid, c.unit_id, score, 1 / (1 + abs(a.q - b.q)) AS sim FROM cand c JOIN size a ON a.unit_id = qid JOIN size b ON b.unit_id = c.unit_id),
scaled AS (SELECT *, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 0.0 END AS a, CASE WHEN max(sim) OVER q > min(sim) OVER q THEN (sim - min(sim) OVER q) / (max(sim) OVER q - min(sim) OVER q) ELSE 0.0 END AS b FROM both_ WINDOW q AS (PARTITION BY qid))
SELECT alpha, qid, unit_id, score, row_number() OVER (PARTITION BY alpha, qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT CAST(alpha AS DOUBLE) AS alpha, qid, unit_id, CASE WHEN alpha = 0 THEN score ELSE round((1 - CAST(alpha AS DOUBLE)) * a + CAST(alpha AS DOUBLE) * b, 9) END AS score FROM scaled, (SELECT unnest([0, 0.25, 0.5, 1]) AS alpha)) QUALIFY rank <= 100"""


@query("h9_relevance_hop", _RELEVANCE)
def h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidence = inputs.orders_parts(spark, sf_dir)
    p1, seeds, _ = _seeds(incidence)
    found = seeds.join(incidence, "node_id").groupBy("qid", "unit_id").agg(F.round(F.sum("w"), 6).alias("score")).where("qid <> unit_id")
    size = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.sum("l_quantity").alias("q"))
    own = size.select(F.col("unit_id").alias("qid"), F.col("q").alias("own"))
    similarity = found.select("qid", "unit_id").join(size, "unit_id").join(own, "qid").select("qid", "unit_id", (1 / (1 + F.abs(F.col("own") - F.col("q")))).alias("sim"))
    return graph.relevance_hop(found, similarity, spark.createDataFrame([(a,) for a in (0.0, 0.25, 0.5, 1.0)], "alpha double"))


_PARTS = """
x AS (SELECT l_partkey AS unit_id, l_suppkey AS node_id, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
p1 AS (SELECT DISTINCT unit_id AS qid, unit_id FROM x WHERE unit_id % 100 = 0),
rare AS (SELECT node_id, CAST(CAST(ln(1 + (SELECT count(DISTINCT unit_id) FROM x) / (1 + count(*))) AS FLOAT) AS DOUBLE) AS r FROM x WHERE w <> 0 GROUP BY node_id)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = inputs.supply(spark, sf_dir).select(F.col("node_id").alias("unit_id"), F.col("unit_id").alias("node_id"), "w")
    return x, x.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "unit_id").distinct()


@query("h4_concept_hop", f"WITH {_PARTS}, s AS (SELECT qid, unit_id, round(sum(o.w * r * x.w), 6) AS score FROM (SELECT qid, node_id, w FROM p1 JOIN x USING (unit_id)) o JOIN rare USING (node_id) JOIN x USING (node_id) GROUP BY qid, unit_id HAVING qid <> unit_id) SELECT qid, unit_id, score, positives, rank, positives / (SELECT count(DISTINCT unit_id) FROM x) AS reach FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS positives, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM s WHERE score > 0) WHERE rank <= 100")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, p1 = _parts(spark, sf_dir)
    return graph.concept_hop(p1, x)


_STEPS = {
    "none": "SELECT unit_id, node_id, w AS left_w, w AS right_w, r FROM x JOIN rare USING (node_id)",
    "symmetric": "SELECT unit_id, node_id, w / sqrt(du * dc) AS left_w, w / sqrt(du * dc) AS right_w, r FROM x JOIN du USING (unit_id) JOIN dc USING (node_id) JOIN rare USING (node_id)",
    "stochastic": "SELECT unit_id, node_id, w / du AS left_w, w / dc AS right_w, r FROM x JOIN du USING (unit_id) JOIN dc USING (node_id) JOIN rare USING (node_id)",
}


def _walk_sql(normalization: str, last: str) -> str:
    """Five chained rounds, with frozen queries carried along."""
    parts = [f"WITH {_PARTS}, du AS (SELECT unit_id, sum(w) AS du FROM x GROUP BY 1), dc AS (SELECT node_id, sum(w) AS dc FROM x GROUP BY 1), steps AS MATERIALIZED ({_STEPS[normalization]}), st0 AS (SELECT qid, unit_id, CAST(1 AS DOUBLE) AS mass, 0 AS rounds, '' AS stop FROM p1)"]
    for k in range(1, 6):
        parts.append(f"""
n{k} AS MATERIALIZED (SELECT qid, node_id, sum(mass * left_w) * any_value(r) AS c FROM st{k - 1} JOIN steps USING (unit_id) WHERE stop = '' GROUP BY qid, node_id),
b{k} AS MATERIALIZED (SELECT qid, unit_id, p / sum(p) OVER (PARTITION BY qid) AS p FROM (SELECT qid, unit_id, sum(c * right_w) AS p FROM n{k} JOIN steps USING (node_id) GROUP BY qid, unit_id)),
m{k} AS MATERIALIZED (SELECT qid, unit_id, sum(nw) AS mass, sum(od) AS od FROM (SELECT qid, unit_id, 0.5 * p AS nw, CAST(0 AS DOUBLE) AS od FROM b{k} UNION ALL SELECT qid, unit_id, 0.5 * mass, 0 FROM st0 WHERE qid IN (SELECT qid FROM st{k - 1} WHERE stop = '') UNION ALL SELECT qid, unit_id, 0, mass FROM st{k - 1} WHERE stop = '') GROUP BY qid, unit_id),
st{k} AS MATERIALIZED (SELECT qid, unit_id, mass, {k} AS rounds, CASE WHEN d <= 1e-12 THEN 'converged' WHEN d < 1e-3 THEN 'threshold' ELSE '{"cap" if k == 5 else ""}' END AS stop FROM (SELECT *, sum(abs(mass - od)) OVER (PARTITION BY qid) AS d FROM m{k}) UNION ALL SELECT * FROM st{k - 1} WHERE stop <> '')""")
    return ",".join(parts) + " " + last


_RANKED = "SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT qid, unit_id, score FROM (SELECT qid, unit_id, round(mass, 8) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(mass, 8) DESC, unit_id) AS r FROM st5 WHERE round(mass, 8) > 0) WHERE r <= 100 UNION SELECT qid, unit_id, round(mass, 8) FROM st5 WHERE qid = unit_id) QUALIFY rank <= 100"


def _walked(spark: SparkSession, sf_dir: str, normalization: str, best: int) -> tuple[DataFrame, DataFrame]:
    x, p1 = _parts(spark, sf_dir)
    seeds = walk.seed_mass(p1.withColumn("score", F.lit(1.0)))
    return walk.walk(seeds, x, 0.5, normalization, best=best), seeds


for _name in _STEPS:

    @query(f"g4_walk_{_name}", _walk_sql(_name, _RANKED))
    def g4(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        walked, seeds = _walked(spark, sf_dir, name, 100)
        return walk.ranked(walked, seeds)


@query("g6_walk_statistics", _walk_sql("symmetric", "SELECT rounds, stop, count(*) AS queries, sum(rounds) * 2 AS products FROM (SELECT qid, max(rounds) AS rounds, max(stop) AS stop FROM st5 GROUP BY qid) GROUP BY rounds, stop"))
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.statistics(_walked(spark, sf_dir, "symmetric", 1)[0])


_TRACE = " UNION ALL ".join(f"SELECT qid, {k} AS round, change, node_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM (SELECT qid, round(d, 8) AS change, node_id, round(c, 8) AS score FROM n{k} JOIN (SELECT qid, sum(abs(mass - od)) AS d FROM m{k} GROUP BY qid) USING (qid)) WHERE score > 0 QUALIFY rank <= 10" for k in range(1, 6))


@query("g7_trace", _walk_sql("symmetric", _TRACE))
def g7_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round by round: how far each query's masses moved, and the ten nodes that most mass moved through."""
    x, p1 = _parts(spark, sf_dir)
    seeds = walk.seed_mass(p1.withColumn("score", F.lit(1.0)))
    trace = walk.new_trace(seeds, x)
    walk.walk(seeds, x, 0.5, "symmetric", trace=trace)
    return trace.read()


@query("g7_entering_units", _walk_sql("symmetric", "SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT qid, unit_id, round(mass - CASE WHEN qid = unit_id THEN 1 ELSE 0 END, 8) AS score FROM st5) WHERE score > 0 QUALIFY rank <= 10"))
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.entering(*_walked(spark, sf_dir, "symmetric", 10))


@query("c5_row_normalised", f"WITH {_PARTS} SELECT unit_id, node_id, round(w / sum(w) OVER (PARTITION BY unit_id), 9) AS w FROM x")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.row_normalized(_parts(spark, sf_dir)[0]).select("unit_id", "node_id", F.round("w", 9).alias("w"))


@query("a7_coactivation", f"WITH {_PARTS} SELECT a.node_id, b.node_id AS other_id, count(*) AS units FROM x a JOIN x b ON a.unit_id = b.unit_id AND a.node_id <> b.node_id GROUP BY ALL")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.coactivation(_parts(spark, sf_dir)[0])


@query("k7_top_units_per_node", f"WITH {_PARTS} SELECT node_id, unit_id, w AS score, row_number() OVER (PARTITION BY node_id ORDER BY w DESC, unit_id) AS rank FROM x QUALIFY rank <= 25")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.top_units(_parts(spark, sf_dir)[0])


@query("k9_truncated_rows", f"WITH {_PARTS} SELECT unit_id, node_id, w FROM x QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY w DESC, node_id) <= 8")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncate_rows(_parts(spark, sf_dir)[0], 8)


@query("a19_structure", f"WITH {_PARTS}, p AS (SELECT node_id, count(*) AS units, sum(m) AS mass FROM (SELECT *, w / sum(w) OVER (PARTITION BY unit_id) AS m FROM x) WHERE w <> 0 GROUP BY node_id) SELECT node_id AS hub, round(units / (SELECT count(DISTINCT unit_id) FROM x), 9) AS hub_share, round(mass / (SELECT sum(mass) FROM p), 9) AS hub_mass, (SELECT count(*) FROM p WHERE units < 30) AS thin, (SELECT count(*) FROM p) AS nodes FROM p ORDER BY units DESC, node_id LIMIT 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.structure(_parts(spark, sf_dir)[0])


@query("r6_concept_retrieval", f"WITH {_PARTS}, s AS (SELECT qid, x.unit_id, round(sum(o.w * r * x.w), 6) AS score FROM (SELECT qid, node_id, w FROM p1 JOIN x USING (unit_id)) o JOIN rare USING (node_id) JOIN x USING (node_id) GROUP BY ALL), f AS (SELECT qid, unit_id, coalesce(score, 0) AS score FROM (SELECT qid, u.unit_id FROM p1, (SELECT DISTINCT unit_id FROM x) u) LEFT JOIN s USING (qid, unit_id)) SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM f QUALIFY rank <= 100")
def r6c(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, p1 = _parts(spark, sf_dir)
    n = x.select("unit_id").distinct().count()
    rare = graph.document_frequency(x).select("node_id", graph.rarity(n, F.col("df")).alias("r"))
    return concepts.concept_retrieval(p1.join(x, "unit_id").select("qid", "node_id", F.col("w").alias("c")), x, rare=rare)


def _space(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    """512 atoms over 30 rounds, or half as many atoms as there are vectors where these are fewer than 1,024; near-equal ones merged."""
    units = inputs.vectors(spark, sf_dir).select("unit_id", "v")
    return units, concepts.merged(concepts.induce(units, max(1, min(512, units.count() // 2))))


@query("c2_sparse_code")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors over an induced dictionary; tested by the optimum's conditions."""
    units, atoms = _space(spark, sf_dir)
    return concepts.code_corpus(units, atoms, 0.05)


@query("r3_query_concepts")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, atoms = _space(spark, sf_dir)
    return concepts.query_concepts(units.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "v"), atoms)


@query("c10_coherence")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, atoms = _space(spark, sf_dir)
    return concepts.quality(concepts.code_corpus(units, atoms, 0.05), units, atoms)


_NULL = """WITH unit AS (SELECT vec_id AS unit_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS l FROM embeddings), pool AS (SELECT * FROM unit ORDER BY sha1('42:' || unit_id), unit_id LIMIT 5000),
drawn AS (SELECT draw, unit_id FROM pool, range(200) t(draw) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY sha1('42:' || draw || ':' || unit_id), unit_id) <= 25),
summed AS (SELECT draw, place, sum(x) AS s, count(*) AS n FROM (SELECT draw, generate_subscripts(embedding, 1) AS place, CAST(unnest(embedding) AS DOUBLE) / l AS x FROM drawn JOIN pool USING (unit_id)) GROUP BY draw, place)
SELECT CAST(draw AS INTEGER) AS draw, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 9) AS coherence FROM summed GROUP BY draw"""


@query("c9_null_sets", _NULL)
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.null_sets(inputs.vectors(spark, sf_dir).select("unit_id", "v"))
