"""Queries: query-aware hops over documents' own sentences, windows and vectors, and full grids as products."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplattice.operators import fusion, graph, grids, mentions, metrics, product, rank, rerank, seeds, vector
from hoplattice.plans import fragments as sql
from hoplattice.plans import inputs, retrieval
from hoplattice.sources.cache import ContentCache, content_key
from hoplattice.sources.tables import shared_folder, small, stored, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    """Registers a query and the SQL that checks it."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# The grids' cells. A missing number of sentences, nodes or units means all of them.
SENTENCES, SEEDS, ALPHAS, CAPS = (1, 2, None), (1, 2, 3, None), (0.0, 0.25, 0.5, 0.75, 1.0), (30, 100, 300, 1000, None)
SENTENCE_CELLS = [(s, x) for s in (1, 2, 3, None) for x in (False, True)]
ALL = 0  # how "all" is written in a result


# --- the relevance stage over vectors --------------------------------------------------------------------------


def _vector_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents that have a vector of their own number: vectors, their nodes, and the query set with its dense list."""
    units = inputs.vectors(spark, sf_dir).select("unit_id", "v")
    nodes = stored(inputs.entities(spark, sf_dir).join(units.select("unit_id"), "unit_id", "left_semi"), "vector-nodes")
    queries = units.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "v")
    return units, nodes, queries


_VECTOR_NODES = """
v_inc AS (SELECT DISTINCT doc_id AS unit_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS node_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
v_w AS (SELECT node_id, count(*) AS df, CAST(CAST(ln(1 + (SELECT count(DISTINCT unit_id) FROM v_inc) / (1 + count(*))) AS FLOAT) AS DOUBLE) AS w FROM v_inc GROUP BY node_id),
v_cand AS (SELECT qid, unit_id, round(sum(w), 6) AS score FROM (SELECT d.qid, i.node_id, w FROM dense d JOIN v_inc i ON d.unit_id = i.unit_id AND d.rank = 1 JOIN v_w USING (node_id)) JOIN v_inc USING (node_id) GROUP BY qid, unit_id),
v_read AS (SELECT qid, unit_id FROM dense WHERE rank <= 10),
v_sim AS (SELECT c.qid, c.unit_id, c.score, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])), 6) AS sim FROM v_cand c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings u ON u.vec_id = c.unit_id WHERE c.score > 0 AND (c.qid, c.unit_id) NOT IN (SELECT qid, unit_id FROM v_read)),
v_norm AS (SELECT qid, unit_id, score, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 0.0 END AS a, CASE WHEN max(sim) OVER q > min(sim) OVER q THEN (sim - min(sim) OVER q) / (max(sim) OVER q - min(sim) OVER q) ELSE 0.0 END AS b FROM v_sim WINDOW q AS (PARTITION BY qid))"""
_ALPHA_LIST = ", ".join(f"(CAST({a} AS DOUBLE))" for a in ALPHAS)
_STAGE = f"""WITH {sql.DENSE}, {_VECTOR_NODES}, alphas(alpha) AS (VALUES {_ALPHA_LIST}),
staged AS (SELECT alpha, qid, unit_id, score, row_number() OVER (PARTITION BY alpha, qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT alpha, qid, unit_id, CASE WHEN alpha = 0 THEN score ELSE round((1 - alpha) * a + alpha * b, 9) END AS score FROM v_norm, alphas) QUALIFY rank <= 100)"""


def _stage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    units, nodes, queries = _vector_units(spark, sf_dir)
    first = vector.dense_topk(queries, units)
    alphas = spark.createDataFrame([(a,) for a in ALPHAS], "alpha double")
    return stored(graph.relevance_stage(first, nodes, queries, units, alphas), "staged"), first, nodes, queries


@query("h16_relevance_stage", f"{_STAGE} SELECT alpha, qid, unit_id, score, rank FROM staged")
def h16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector: candidates share capitalised words with the dense list's first unit, cosines are taken for candidates alone."""
    return _stage(spark, sf_dir)[0].select("alpha", "qid", "unit_id", "score", "rank")


# --- sentences and windows of the first unit --------------------------------------------------------------------

_SPACE = r"[ \t\n\r\f\v]"
# a node here is one word, so it is named where a run of word characters equals it
_TOKENS = r"unnest(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')) AS token"


_SAID = f"""WITH {sql.BM25} {sql.ENTITIES},
said AS (SELECT qid, CAST(generate_subscripts(pieces, 1) - 1 AS INTEGER) AS sentence, unnest(pieces) AS said FROM (SELECT qid, list_filter(string_split_regex(text, '[.!?]{_SPACE}+|\\n+'), lambda x: NOT regexp_full_match(x, '{_SPACE}*')) AS pieces FROM p1 JOIN documents ON doc_id = unit_id)),
named AS (SELECT DISTINCT qid, node_id FROM seeds JOIN (SELECT item_id AS qid, {_TOKENS.format('text')} FROM benchmark) USING (qid) WHERE token = node_id),
held AS (SELECT DISTINCT qid, node_id, sentence, said FROM seeds JOIN (SELECT qid, sentence, said, {_TOKENS.format('said')} FROM said) USING (qid) WHERE token = node_id),
worded AS (SELECT qid, sentence, ws, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT qid, sentence, list_filter(string_split_regex(said, '{_SPACE}+'), lambda x: x <> '') AS ws FROM said)),
around AS (SELECT DISTINCT qid, node_id, around FROM (SELECT s.qid, node_id, array_to_string(list_concat(ws[greatest(i - 5, 1):i - 1], ws[i + 1:i + 5]), ' ') AS around FROM seeds s JOIN (SELECT qid, ws, i, {_TOKENS.format('word')} FROM worded) USING (qid) WHERE token = node_id) WHERE around <> ''),
texts AS (SELECT said AS t FROM said UNION SELECT around FROM around UNION SELECT text FROM benchmark),
hashed AS (SELECT t, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64 AS b, sum(CASE WHEN substr(md5(w), 5, 1) < '8' THEN 1 ELSE -1 END) AS x FROM (SELECT t, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM texts) GROUP BY ALL),
lengths AS (SELECT t, sqrt(sum(x * x)) AS l FROM hashed GROUP BY t),
asked_for AS (SELECT DISTINCT qid, said AS t FROM said UNION SELECT qid, around FROM around),
sims AS (SELECT qid, t, round(coalesce(sum(a.x * b.x / la.l / lb.l), 0), 6) AS sim FROM asked_for JOIN benchmark ON item_id = qid LEFT JOIN hashed a USING (t) LEFT JOIN lengths la USING (t) LEFT JOIN hashed b ON b.t = text AND b.b = a.b LEFT JOIN lengths lb ON lb.t = text GROUP BY qid, t)"""


def _first_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """BM25's list, the nodes of documents, and every mention of the first document's own nodes."""
    first = inputs.bm25(spark, sf_dir)
    nodes = stored(inputs.entities(spark, sf_dir), "entities")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    texts = docs.join(small(first.where("rank = 1").select("qid", "unit_id")), "unit_id").join(small(inputs.questions(spark, sf_dir).withColumnRenamed("query", "question")), "qid")
    forms = nodes.select("unit_id", "node_id", F.col("node_id").alias("form"))
    return first, nodes, stored(mentions.located(texts, forms), "mentions")


def _cache(spark: SparkSession) -> ContentCache:
    """A cache of its own for each run, so that a run's counts do not depend on earlier ones."""
    return ContentCache(spark, f"{shared_folder(spark)}/text-cache-{uuid.uuid4().hex}", "hashed words, 64", "v array<double>, touched array<int>")


def _keyed(df: DataFrame, text: Column) -> DataFrame:
    return df.select("*", content_key(text).alias("content_id"), text.alias("text"))


def _similar(spark: SparkSession, sf_dir: str, wanted: DataFrame, cache: ContentCache) -> DataFrame:
    """``(qid, content_id, sim)``: cosines of texts ``(qid, content_id, text)`` with their question; vectors are computed once for each text."""
    questions = _keyed(inputs.questions(spark, sf_dir), F.col("query")).select("qid", "content_id", "text")
    cache.fill(wanted.select("content_id", "text").union(questions.select("content_id", "text")), vector.hashed_vectors)
    of_questions = cache.lookup(questions.select("qid", "content_id")).select("qid", "v", "touched")
    units = cache.lookup(wanted.select("content_id").distinct()).select(F.col("content_id").alias("unit_id"), "v", "touched")
    return vector.hashed_cosines(wanted.select("qid", F.col("content_id").alias("unit_id")).distinct(), of_questions, units).withColumnRenamed("unit_id", "content_id")


def _said(found: DataFrame) -> DataFrame:
    return _keyed(found.where("said IS NOT NULL").select("qid", "sentence", "said").distinct(), F.col("said")).drop("said")


def _sentence_seeds(spark: SparkSession, sf_dir: str, found: DataFrame, cells: list[tuple[int | None, bool]]) -> DataFrame:
    """``(s, excluded, qid, node_id)`` of every cell: nodes of the ``s`` sentences nearest the question, those that it names left out or not."""
    said = _said(found)
    relevance = stored(said.join(_similar(spark, sf_dir, said, _cache(spark)), ["qid", "content_id"]).select("qid", "sentence", F.col("sim").alias("rel")), "relevance")
    named = found.where("named").select("qid", "node_id")
    parts = []
    for s, excluded in cells:
        own = seeds.from_sentences(found.select("qid", "sentence", "node_id"), relevance, s, named if excluded else None)
        parts.append(own.select(F.lit(s or ALL).alias("s"), F.lit(excluded).alias("excluded"), "qid", "node_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stored(out, "sentence-seeds")


def _cells_hop(chosen: DataFrame, cell: tuple[str, ...], nodes: DataFrame, read: DataFrame) -> DataFrame:
    """The seeded hop of all cells at once: a cell and its question are the query."""
    weighted = chosen.join(graph.weights(nodes).select("node_id", "w"), "node_id").select(F.struct(*cell, "qid").alias("qid"), "node_id", "w")
    of_cells = chosen.select(*cell).distinct().crossJoin(F.broadcast(read.select("qid", "unit_id"))).select(F.struct(*cell, "qid").alias("qid"), "unit_id")
    return graph.seeded_hop(stored(weighted, "cell-seeds"), nodes, of_cells).select("qid.*", "unit_id", "score", "positives", "rank")


def _cells_sql(cells: list[tuple[int | None, bool]]) -> str:
    rows = ", ".join(f"({s or ALL}, {str(x).lower()})" for s, x in cells)
    return f"""{_SAID}, cells(s, excluded) AS (VALUES {rows}),
eligible AS (SELECT s, excluded, qid, node_id, w FROM cells, seeds WHERE NOT (excluded AND (qid, node_id) IN (SELECT qid, node_id FROM named))),
holding AS (SELECT s, excluded, qid, sentence, row_number() OVER (PARTITION BY s, excluded, qid ORDER BY sim DESC, sentence) AS place FROM (SELECT DISTINCT s, excluded, qid, sentence, said FROM eligible JOIN held USING (qid, node_id)) h JOIN sims USING (qid) WHERE t = said),
chosen AS (SELECT s, excluded, qid, node_id, w FROM eligible WHERE s = {ALL} UNION SELECT DISTINCT e.s, e.excluded, e.qid, e.node_id, e.w FROM eligible e JOIN held USING (qid, node_id) JOIN holding USING (s, excluded, qid, sentence) WHERE e.s > 0 AND place <= e.s),
cell_hop AS (SELECT s, excluded, qid, unit_id, score, count(*) OVER (PARTITION BY s, excluded, qid) AS positives, row_number() OVER (PARTITION BY s, excluded, qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT s, excluded, qid, unit_id, round(sum(w), 6) AS score FROM chosen JOIN incidence USING (node_id) GROUP BY ALL) WHERE score > 0 AND (qid, unit_id) NOT IN (SELECT qid, unit_id FROM bm25 WHERE rank <= 10) QUALIFY rank <= 100)"""


@query("h14_document_sentence_hop", f"{_cells_sql(SENTENCE_CELLS)} SELECT s, excluded, qid, unit_id, score, positives, rank FROM cell_hop")
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One, two, three or all sentences of each question's first document, with and without the nodes that the question names."""
    first, nodes, found = _first_texts(spark, sf_dir)
    return _cells_hop(_sentence_seeds(spark, sf_dir, found, SENTENCE_CELLS), ("s", "excluded"), nodes, first.where("rank <= 10"))


def _gates(spark: SparkSession, sf_dir: str, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(m, qid, node_id)``: the ``m`` nodes whose best window is nearest the question; all of the first document's nodes for all."""
    windows = _keyed(found.where("window <> ''").select("qid", "node_id", "window").distinct(), F.col("window")).drop("window")
    near = stored(windows.join(_similar(spark, sf_dir, windows, _cache(spark)), ["qid", "content_id"]).select("qid", "node_id", "sim"), "window-similarity")
    ranked = stored(seeds.from_windows(near, graph.weights(nodes), None).select("qid", "node_id", "place"), "ranked-nodes")
    out = found.select(F.lit(ALL).alias("m"), "qid", "node_id").distinct()
    for m in SEEDS:
        if m:
            out = out.unionByName(ranked.where(F.col("place") <= m).select(F.lit(m).alias("m"), "qid", "node_id"))
    return stored(out, "gates")


def _gated(gates: DataFrame, nodes: DataFrame, first: DataFrame) -> DataFrame:
    """The gated hop of every gate size at once."""
    cell = F.struct("m", "qid").alias("qid")
    own = graph.seeds_of(first.where("rank = 1").select("qid", "unit_id"), nodes, graph.weights(nodes))
    sizes = gates.select("m").distinct()
    everything = stored(own.crossJoin(F.broadcast(sizes)).select(cell, "node_id", "w"), "cell-nodes")
    read = first.where("rank <= 10").select("qid", "unit_id").crossJoin(F.broadcast(sizes)).select(cell, "unit_id")
    return graph.gated_hop(everything, gates.select(cell, "node_id"), nodes, read).select("qid.*", "unit_id", "score", "positives", "rank")


_SIZES = ", ".join(f"({m or ALL})" for m in SEEDS)
_GATED = f"""{_SAID}, sizes(m) AS (VALUES {_SIZES}),
nearest AS (SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, w DESC, node_id) AS place FROM (SELECT qid, node_id, max(sim) AS score FROM around JOIN sims USING (qid) WHERE t = around GROUP BY qid, node_id) JOIN node_w USING (node_id)),
gate AS (SELECT m, qid, node_id FROM sizes, nearest WHERE m > 0 AND place <= m UNION SELECT {ALL}, qid, node_id FROM seeds),
gate_hop AS (SELECT m, qid, unit_id, score, count(*) OVER (PARTITION BY m, qid) AS positives, row_number() OVER (PARTITION BY m, qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT m, s.qid, i.unit_id, round(sum(w), 6) AS score FROM sizes CROSS JOIN seeds s JOIN incidence i USING (node_id) LEFT JOIN gate g USING (m, qid, node_id) GROUP BY m, s.qid, i.unit_id HAVING count(g.node_id) > 0) WHERE score > 0 AND (qid, unit_id) NOT IN (SELECT qid, unit_id FROM bm25 WHERE rank <= 10) QUALIFY rank <= 100)"""
# LEFT JOIN USING would hide the gate's node; it is joined by its own name
_GATED = _GATED.replace("LEFT JOIN gate g USING (m, qid, node_id)", "LEFT JOIN gate g ON g.m = sizes.m AND g.qid = s.qid AND g.node_id = s.node_id").replace("SELECT m, s.qid, i.unit_id", "SELECT sizes.m AS m, s.qid, i.unit_id").replace("GROUP BY m, s.qid", "GROUP BY sizes.m, s.qid")


@query("h15_document_window_hop", f"{_GATED} SELECT m, qid, unit_id, score, positives, rank FROM gate_hop")
def h15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of one, two, three or all nodes, chosen by the windows around their mentions in the first document."""
    first, nodes, found = _first_texts(spark, sf_dir)
    return _gated(_gates(spark, sf_dir, found, nodes), nodes, first)


@query("s24_text_cache", f"{_SAID}, once AS (SELECT count(*) AS n FROM (SELECT DISTINCT said FROM held)) SELECT n AS wanted, n AS first_run, CAST(0 AS BIGINT) AS second_run, n AS stored, CAST(0 AS BIGINT) AS conflicts FROM once")
def s24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that name a node, embedded twice over: the second run finds everything stored."""
    said = _said(_first_texts(spark, sf_dir)[2])
    cache = _cache(spark)
    computed = [cache.fill(said, vector.hashed_vectors) for _ in range(2)]
    found = cache.lookup(said.select("content_id").distinct())
    return found.agg(F.count("*").alias("wanted")).select("wanted", *(F.lit(n).cast("long").alias(c) for n, c in zip(computed, ("first_run", "second_run"), strict=True)), F.lit(cache.table().count()).cast("long").alias("stored"), F.lit(cache.conflicts().count()).cast("long").alias("conflicts"))


# --- grids ------------------------------------------------------------------------------------------------------

_NORM = "CASE WHEN max(score) OVER l > min(score) OVER l THEN (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) ELSE 0.0 END"


def _grid_sql(before: str, parts: str, cell: list[str], names: list[str], gold: str, counts: str) -> str:
    """The first ten of each list at each point, tallied: ``parts`` has (cell, component, qid, unit_id, score)."""
    points = ", ".join(f"({k}, {', '.join(str(p[n]) for n in names)})" for k, p in enumerate(grids.simplex(names)))
    c, on = ", ".join(cell), ", ".join([*cell, "qid"])
    score = " + ".join(f"w_{n} * n_{n}" for n in names)
    norms = ", ".join(f"coalesce(max(norm) FILTER (component = '{n}'), 0.0) AS n_{n}" for n in names)
    return f"""{before}, points(point, {', '.join(f'w_{n}' for n in names)}) AS (VALUES {points}),
parts AS ({parts}), normed AS (SELECT *, {_NORM} AS norm FROM parts WINDOW l AS (PARTITION BY component, {on})),
grid_wide AS (SELECT {on}, unit_id, {norms} FROM normed GROUP BY {on}, unit_id),
grid_gold AS ({gold}), grid_counts AS ({counts}),
grid_first AS (SELECT {on}, point, unit_id FROM (SELECT {on}, point, unit_id, round({score}, 6) AS score FROM grid_wide, points) QUALIFY row_number() OVER (PARTITION BY {on}, point ORDER BY score DESC, unit_id) <= 10),
per_list AS (SELECT {on}, point, count(g.unit_id) AS found FROM grid_first f LEFT JOIN grid_gold g ON g.qid = f.qid AND g.unit_id = f.unit_id GROUP BY {', '.join(f'f.{x}' for x in [*cell, 'qid'])}, point)
SELECT {c}, point, CAST(sum(found) AS BIGINT) AS found, round(avg(found / n_gold), 9) AS recall, CAST(sum(CAST(found = n_gold AS INTEGER)) AS BIGINT) AS supported FROM per_list JOIN grid_counts USING (qid) WHERE n_gold > 0 GROUP BY {c}, point""".replace(f"SELECT {on}, point, count(g.unit_id)", f"SELECT {', '.join(f'f.{x}' for x in [*cell, 'qid'])}, point, count(g.unit_id)")


def _grid(lists: DataFrame, cell: list[str], names: list[str], gold: DataFrame, counts: DataFrame) -> DataFrame:
    tallied = product.outcomes(stored(lists, "grid-lists"), names, product.weights_of(names), gold, by=(*cell, "qid"))
    return product.summary(tallied, counts, tuple(cell)).select(*cell, "point", "found", "recall", "supported")


def _for_cells(lists: DataFrame, cells: DataFrame) -> DataFrame:
    """Lists that do not depend on the cell, for every cell."""
    return lists.crossJoin(F.broadcast(cells))


_GOLD = "SELECT qid, unit_id FROM qrels"
_COUNTS = "SELECT qid, n_gold FROM gold"
_PLAIN = "SELECT {cell}, 'bm25' AS component, qid, unit_id, score FROM bm25, {cells} UNION ALL SELECT {cell}, 'overlap', qid, unit_id, score FROM shared, {cells} UNION ALL SELECT {cell}, 'hop', qid, unit_id, score FROM {hop}"
_TRIPLE = ["bm25", "overlap", "hop"]


def _plain_lists(spark: SparkSession, sf_dir: str, first: DataFrame) -> DataFrame:
    return stored(fusion.components(bm25=first, overlap=inputs.overlap(spark, sf_dir)), "plain-lists")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = inputs.qrels(spark, sf_dir)
    return gold, metrics.gold_counts(inputs.questions(spark, sf_dir), gold)


def _hop_grid(spark: SparkSession, sf_dir: str, first: DataFrame, hop: DataFrame, cell: list[str]) -> DataFrame:
    hop = stored(hop.select(*cell, "qid", "unit_id", "score"), "cell-hops")
    plain = _for_cells(_plain_lists(spark, sf_dir, first), stored(hop.select(*cell).distinct(), "cells"))
    return _grid(plain.unionByName(hop.withColumn("component", F.lit("hop"))), cell, _TRIPLE, *_answers(spark, sf_dir))


_X6_CELLS = [(s, x) for s in SENTENCES for x in (False, True)]


@query("x6_seed_triple_grid", _grid_sql(f"{_cells_sql(_X6_CELLS)} {sql.OVERLAP} {sql.GOLD}", _PLAIN.format(cell="s, excluded", cells="(SELECT DISTINCT s, excluded FROM cell_hop)", hop="cell_hop"), ["s", "excluded"], _TRIPLE, _GOLD, _COUNTS))
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sets of sentence seeds by 66 weights: 396 points."""
    first, nodes, found = _first_texts(spark, sf_dir)
    hop = _cells_hop(_sentence_seeds(spark, sf_dir, found, _X6_CELLS), ("s", "excluded"), nodes, first.where("rank <= 10"))
    return _hop_grid(spark, sf_dir, first, hop, ["s", "excluded"])


@query("x7_window_triple_grid", _grid_sql(f"{_GATED} {sql.OVERLAP} {sql.GOLD}", _PLAIN.format(cell="m", cells="(SELECT DISTINCT m FROM gate_hop)", hop="gate_hop"), ["m"], _TRIPLE, _GOLD, _COUNTS))
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four gate sizes by 66 weights: 264 points."""
    first, nodes, found = _first_texts(spark, sf_dir)
    return _hop_grid(spark, sf_dir, first, _gated(_gates(spark, sf_dir, found, nodes), nodes, first), ["m"])


_V_TRIPLE = ["dense", "nodes", "hop"]
_V_NODES = "v_nodes AS (SELECT qid, unit_id, score FROM (SELECT q.vec_id AS qid, i.unit_id, round(sum(w), 6) AS score FROM embeddings q JOIN v_inc o ON q.vec_id % 100 = 0 AND o.unit_id = q.vec_id JOIN v_w USING (node_id) JOIN v_inc i USING (node_id) WHERE i.unit_id <> q.vec_id GROUP BY ALL) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) <= 100)"
_V_GOLD = "SELECT q.vec_id AS qid, u.vec_id AS unit_id FROM embeddings q JOIN embeddings u ON q.vec_id % 100 = 0 AND q.label = u.label AND q.vec_id <> u.vec_id"


@query("x8_alpha_triple_grid", _grid_sql(f"{_STAGE}, {_V_NODES}", "SELECT alpha, 'dense' AS component, qid, unit_id, score FROM dense, alphas UNION ALL SELECT alpha, 'nodes', qid, unit_id, score FROM v_nodes, alphas UNION ALL SELECT alpha, 'hop', qid, unit_id, score FROM staged", ["alpha"], _V_TRIPLE, _V_GOLD, "SELECT qid, count(*) AS n_gold FROM grid_gold GROUP BY qid"))
def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five shares of similarity by 66 weights over the dense list, the hop from the query's own nodes and the relevance hop: 330 points."""
    staged, first, nodes, queries = _stage(spark, sf_dir)
    own = graph.node_hop(queries.select("qid", F.col("qid").alias("unit_id")), nodes)
    alphas = stored(staged.select("alpha").distinct(), "cells")
    plain = _for_cells(fusion.components(dense=first, nodes=own), alphas)
    lists = plain.unionByName(staged.select("alpha", F.lit("hop").alias("component"), "qid", "unit_id", "score"))
    labels = inputs.vectors(spark, sf_dir).select("unit_id", "label")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    asked = labels.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), F.col("label").alias("asked_label"))
    # gold is looked up for the units of the lists, never paired
    listed = stored(lists.select("qid", "unit_id").distinct(), "listed")
    gold = listed.join(labels, "unit_id").join(small(asked), "qid").where("label = asked_label AND qid <> unit_id").select("qid", "unit_id")
    counts = asked.join(sizes, asked["asked_label"] == sizes["label"]).select("qid", "n_gold")
    return _grid(lists, ["alpha"], _V_TRIPLE, gold, counts)


_QUAD = ["bm25", "overlap", "hop", "question"]
_CAP_LIST = ", ".join(f"({c or ALL})" for c in CAPS)
_CAPPED = f"""{retrieval._QHOP}, caps(cap) AS (VALUES {_CAP_LIST}),
cap_hop AS (SELECT cap, qid, unit_id, score FROM (SELECT cap, qid, unit_id, round(sum(w), 6) AS score FROM caps, seeds JOIN incidence USING (node_id) WHERE cap = {ALL} OR df <= cap GROUP BY ALL) WHERE score > 0 AND (qid, unit_id) NOT IN (SELECT qid, unit_id FROM bm25 WHERE rank <= 10) QUALIFY row_number() OVER (PARTITION BY cap, qid ORDER BY score DESC, unit_id) <= 100) {sql.GOLD}"""


@query("x5_cap_quad_grid", _grid_sql(_CAPPED, "SELECT cap, 'bm25' AS component, qid, unit_id, score FROM bm25, caps UNION ALL SELECT cap, 'overlap', qid, unit_id, score FROM shared, caps UNION ALL SELECT cap, 'question', qid, unit_id, score FROM qhop, caps UNION ALL SELECT cap, 'hop', qid, unit_id, score FROM cap_hop", ["cap"], _QUAD, _GOLD, _COUNTS))
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five caps of document frequency by 286 weights of four lists: 1,430 points."""
    first = inputs.bm25(spark, sf_dir)
    nodes = stored(inputs.entities(spark, sf_dir), "entities")
    weights = stored(graph.weights(nodes), "weights")
    own = stored(first.where("rank = 1").select("qid", "unit_id").join(nodes, "unit_id").select("qid", "node_id").distinct().join(weights.select("node_id", "df", "w"), "node_id"), "own-nodes")
    caps = spark.createDataFrame([(c or ALL,) for c in CAPS], "cap int")
    cell = F.struct("cap", "qid").alias("qid")
    capped = own.crossJoin(F.broadcast(caps)).where(f"cap = {ALL} OR df <= cap").select(cell, "node_id", "w")
    read = first.where("rank <= 10").select("qid", "unit_id").crossJoin(F.broadcast(caps)).select(cell, "unit_id")
    hop = graph.seeded_hop(stored(capped, "cell-seeds"), nodes, read).select("qid.*", "unit_id", "score")
    plain = fusion.components(bm25=first, overlap=inputs.overlap(spark, sf_dir), question=retrieval._question_hop(spark, sf_dir, first))
    lists = _for_cells(stored(plain, "plain-lists"), caps).unionByName(hop.withColumn("component", F.lit("hop")))
    return _grid(lists, ["cap"], _QUAD, *_answers(spark, sf_dir))


@query("m6_grid_outcomes")
def m6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold in the contexts of all 66 weights at four budgets, filled in the tasks (tests compare it with the plain fill)."""
    lists = inputs.lists(spark, sf_dir)
    gold, counts = _answers(spark, sf_dir)
    units = lists.select("unit_id").distinct()
    tokens = inputs.tokens(spark, sf_dir).join(small(units), "unit_id", "left_semi")
    tallied = product.outcomes(lists, _TRIPLE, product.weights_of(_TRIPLE), gold, tokens=tokens, budgets=metrics.BUDGETS)
    return product.summary(tallied, counts)


# --- whole orders, nested corpora, a two-tower judge ------------------------------------------------------------


@query("r7_full_order", f"WITH {sql.DENSE.replace(' QUALIFY rank <= 100', '')} SELECT qid, unit_id, score, rank FROM dense")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector for each vector whose id is divisible by 100."""
    units = inputs.vectors(spark, sf_dir)
    return vector.full_order(units.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "v"), units).select("qid", "unit_id", "score", "rank")


#: Prefixes of the vectors in the order of a hash of their id.
SIZES = (100, 200, 400, None)
_NESTED = f"""WITH placed AS (SELECT *, row_number() OVER (ORDER BY sha1('42:' || vec_id), vec_id) - 1 AS place FROM embeddings), sizes(size) AS (VALUES {', '.join(f'({s or ALL})' for s in SIZES)})
SELECT size, qid, unit_id, score, row_number() OVER (PARTITION BY size, qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT size, q.vec_id AS qid, u.vec_id AS unit_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])), 6) AS score
FROM sizes, embeddings q JOIN placed u ON q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id WHERE size = {ALL} OR place < size) QUALIFY rank <= 20"""


@query("w5_nested_topk", _NESTED)
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty over each prefix of the corpus, the whole corpus included."""
    units = inputs.vectors(spark, sf_dir)
    frozen = F.sha1(F.concat(F.lit("42:"), F.col("unit_id").cast("string")))
    found = vector.nested_topk(units.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "v"), units, SIZES, frozen, F.col("unit_id"), k=20)
    return found.select(F.coalesce("size", F.lit(ALL)).alias("size"), "qid", "unit_id", "score", "rank")


#: A fixed projection of 64 dimensions to 16 for each side, and the logits' scale.
_TOWERS, _SCALE = [np.cos(np.outer(np.arange(1, 17) + shift, np.arange(1, 65))) for shift in (0, 16)], 12.0
_JUDGE = f"""WITH {sql.DENSE}, tower AS (SELECT side, vec_id, i, sum(cos((i + side) * j) * CAST(embedding[j] AS DOUBLE)) AS z FROM embeddings, (VALUES (0), (16)) s(side), range(1, 17) a(i), range(1, 65) b(j) GROUP BY ALL),
lengths AS (SELECT side, vec_id, sqrt(sum(z * z)) AS l FROM tower GROUP BY side, vec_id)
SELECT qid, unit_id, judge, row_number() OVER (PARTITION BY qid ORDER BY judge DESC, place) AS rank FROM (SELECT qid, unit_id, d.rank AS place, round({_SCALE} * sum(q.z * u.z / lq.l / lu.l), 6) AS judge FROM dense d
JOIN tower q ON q.side = 0 AND q.vec_id = qid JOIN tower u ON u.side = 16 AND u.vec_id = unit_id AND u.i = q.i JOIN lengths lq ON lq.side = 0 AND lq.vec_id = qid JOIN lengths lu ON lu.side = 16 AND lu.vec_id = unit_id GROUP BY qid, unit_id, d.rank)"""


@query("q3_two_tower_judge", _JUDGE)
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense lists put into the order of a two-tower judge with a fixed projection."""
    units = inputs.vectors(spark, sf_dir).select("unit_id", "v")
    questions = units.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "v")
    first = vector.dense_topk(questions, units)
    judged = rerank.two_tower(first.select("qid", "unit_id"), questions, units, *_TOWERS, scale=_SCALE)
    return rerank.reorder(first, judged).select("qid", "unit_id", "judge", "rank")


# --- bounds from totals, pilots and navigation ------------------------------------------------------------------

_BOUNDS = f"""WITH RECURSIVE {sql.LISTS} {sql.GOLD} {sql.packed('ctx', 'rrf')} {sql.outcomes('out', 'ctx')} {sql.packed('ctx_b', 'shared')} {sql.outcomes('out_b', 'ctx_b')},
top_ten AS (SELECT qid, CASE WHEN n_gold > 0 THEN (SELECT count(*) FROM bm25 JOIN qrels USING (qid, unit_id) WHERE bm25.qid = gold.qid AND rank <= 10) / n_gold ELSE 0.0 END AS d FROM gold),
apart AS (SELECT a.full_support = 1 AS won, d, CASE WHEN a.full_support = 1 THEN a.context_precision * a.units ELSE b.context_precision * b.units END AS g, CASE WHEN a.full_support = 1 THEN b.gold_recall ELSE a.gold_recall END AS kept FROM out a JOIN out_b b USING (qid, budget) JOIN top_ten USING (qid) WHERE budget = 1024 AND a.full_support <> b.full_support),
counted AS (SELECT won, g, CAST(round(g * (1 - kept)) AS BIGINT) AS changed, CAST(round(g * d) AS BIGINT) AS top FROM (SELECT won, d, kept, CAST(round(g) AS BIGINT) AS g FROM apart)),
bounded AS (SELECT won, changed, greatest(0, top - (g - changed)) AS surely, least(changed, top) AS maybe FROM counted)
SELECT outcome, count(*) AS questions, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(surely) AS BIGINT) AS in_10, CAST(sum(changed - maybe) AS BIGINT) AS beyond_10, CAST(sum(maybe - surely) AS BIGINT) AS undetermined FROM (SELECT *, unnest([CASE WHEN won THEN 'won' ELSE 'lost' END, 'total']) AS outcome FROM bounded) GROUP BY outcome"""


@query("q9_bounded_split", _BOUNDS)
def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks against the overlap list at 1,024 tokens, bounded by BM25's recall in its first ten."""
    lists = inputs.lists(spark, sf_dir)
    overlap = rank.top_k(lists.where("component = 'overlap'").select("qid", "unit_id", "score"), 100)
    first = rank.top_k(lists.where("component = 'bm25'").select("qid", "unit_id", "score"), 100)
    at = lambda hits: inputs.outcomes(spark, sf_dir, hits).where("budget = 1024")
    gold, counts = _answers(spark, sf_dir)
    hits = gold.join(first.where("rank <= 10").select("qid", "unit_id"), ["qid", "unit_id"]).groupBy("qid").agg(F.count("*").alias("n"))
    dense = counts.join(hits, "qid", "left").select("qid", F.when(F.col("n_gold") > 0, F.coalesce("n", F.lit(0)) / F.col("n_gold")).otherwise(0.0).alias("recall_10"))
    return rerank.bounded_rank_split(at(fusion.rrf(lists)), at(overlap), dense)


_V_MISSING = f"""gold AS ({_V_GOLD}), missing AS (SELECT qid, unit_id FROM gold WHERE (qid, unit_id) NOT IN (SELECT qid, unit_id FROM v_read))"""


@query("h19_pilot_set", f"{_STAGE}, {_V_MISSING} SELECT m.qid, d.unit_id AS p1, m.unit_id FROM missing m JOIN dense d ON d.qid = m.qid AND d.rank = 1")
def h19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the query's label that the dense list's first ten miss."""
    units, _, queries = _vector_units(spark, sf_dir)
    return rerank.pilot(vector.dense_topk(queries, units), _label_gold(spark, sf_dir))


def _label_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other vector of the query's label: queries meet the vectors in a broadcast join where they are few."""
    labels = inputs.vectors(spark, sf_dir).select("unit_id", "label")
    asked = labels.where("unit_id % 100 = 0").select(F.col("unit_id").alias("qid"), "label")
    return labels.join(small(asked), "label").where("qid <> unit_id").select("qid", "unit_id")


_ARMS = "SELECT 'continue' AS arm, qid, unit_id, rank - 10 AS rank FROM dense WHERE rank > 10 UNION ALL SELECT 'relevance', qid, unit_id, rank FROM staged WHERE alpha = 0.5 UNION ALL SELECT 'rarity', qid, unit_id, rank FROM staged WHERE alpha = 0 UNION ALL SELECT 'nodes', qid, unit_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) FROM v_nodes"


@query("h18_navigation", f"""{_STAGE}, {_V_NODES}, {_V_MISSING}, arms AS ({_ARMS}), hits AS (SELECT arm, arms.qid, arms.unit_id, rank FROM arms JOIN missing USING (qid, unit_id))
SELECT arm, (SELECT count(*) FROM missing) AS missing, (SELECT count(DISTINCT qid) FROM missing) AS questions, count(*) FILTER (hits.rank <= 10) AS found_10, count(DISTINCT hits.qid) FILTER (hits.rank <= 10) AS questions_10, count(*) FILTER (hits.rank <= 100) AS found_100, count(DISTINCT hits.qid) FILTER (hits.rank <= 100) AS questions_100 FROM (SELECT DISTINCT arm FROM arms) LEFT JOIN hits USING (arm) GROUP BY arm""")
def h18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hops after the dense list's first ten, and what each finds of the gold that these miss."""
    staged, first, nodes, queries = _stage(spark, sf_dir)
    first = stored(first, "dense-list")
    own = graph.node_hop(queries.select("qid", F.col("qid").alias("unit_id")), nodes)
    part = lambda name, df: df.select(F.lit(name).alias("arm"), "qid", "unit_id", F.col("rank").cast("int").alias("rank"))
    arms = part("continue", first.where("rank > 10").withColumn("rank", F.col("rank") - 10))
    for name, df in (("relevance", staged.where("alpha = 0.5")), ("rarity", staged.where("alpha = 0")), ("nodes", own)):
        arms = arms.unionByName(part(name, df))
    return rerank.navigation(stored(arms, "arms"), stored(rerank.pilot(first, _label_gold(spark, sf_dir)), "pilot"))
