"""Queries: summaries, samples, checks, verdicts and seeded hops over orders, documents and vectors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hoplattice.functions import stats
from hoplattice.functions import text as fn
from hoplattice.operators import concepts, corpus, fusion, graph, grids, lexical, paired, rank, seeds, summaries, vector, verdicts
from hoplattice.plans import fragments as sql
from hoplattice.plans import graphs, inputs, retrieval
from hoplattice.sources.tables import stored, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str):
    """Registers a query and the SQL that checks it."""

    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("p7_bounded_occurrence", r"SELECT doc_id, coalesce(contains(' ' || regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}]', ' ', 'g') || ' ', ' ' || lang || ' '), false) AS held FROM documents")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(fn.occurs(F.col("lang"), F.lower("text")), F.lit(False)).alias("held"))


@query("p9_mention_window", r"SELECT doc_id, sha256(array_to_string(list_concat(ws[greatest(k - 5, 1):k - 1], ws[k + 1:k + 5]), ' ')) AS window_sha FROM (SELECT doc_id, ws, list_position(ws, ws[len(ws) // 2 + 1]) AS k FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws FROM documents)) WHERE k > 0")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around the first mention of each document's middle word."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    at = _docs(spark, sf_dir).select("doc_id", "text", F.array_position(words, F.get(words, F.floor(F.size(words) / 2).cast("int"))).alias("k"))
    return at.where("k > 0").select("doc_id", F.sha2(fn.mention_window(F.col("text"), F.col("k") - 1, F.col("k") - 1), 256).alias("window_sha"))


@query("p18_positional_ids", "SELECT conv_id, turn, printf('mhr-%04d', turn) AS qid FROM conversations")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.positional_id(F.col("turn")).alias("qid"))


@query("p24_cost_projection", "SELECT source, round(count(*) / 235.3 / 3600, 9) AS hours, round((sum(n_chars) / 4.0 * 0.15 + count(*) * 60 * 0.6) / 1000000, 9) AS usd FROM documents GROUP BY source")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("units"), (F.sum("n_chars") / 4.0).alias("tokens"))
    return n.select("source", F.round(verdicts.projected_hours(F.col("units"), F.lit(235.3)), 9).alias("hours"), F.round(verdicts.projected_cost(F.col("tokens"), F.col("units") * 60, 0.15, 0.6), 9).alias("usd"))


@query("j1_gold_resolution", "SELECT DISTINCT conv_id AS qid, turn AS unit_id FROM conversations WHERE role IN (SELECT role FROM conversations WHERE turn = 0)")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns by the titles, its roles, that its first turns name."""
    turns = table(spark, sf_dir, "conversations")
    named = turns.where("turn = 0").select(F.col("role").alias("title")).distinct()
    facts = turns.select(F.col("conv_id").alias("qid"), F.col("role").alias("title")).distinct().join(named, "title", "left_semi")
    return corpus.resolve_gold(facts, turns.select(F.col("conv_id").alias("qid"), F.col("role").alias("title"), F.col("turn").alias("unit_id")), None)


_OFFICIAL = "SELECT item_id + 100000 AS official_id, CASE WHEN item_id % 3 = 0 THEN upper(substr(text, 1, 20)) ELSE substr(text, 1, 20) END AS title, CASE WHEN item_id % 3 = 0 THEN '  ' || replace(text, ' ', '  ') ELSE text END AS text FROM benchmark"
_NORMAL = r"trim(regexp_replace({}, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"


@query("j3_reconcile", f"""WITH u AS (SELECT item_id AS unit_id, substr(text, 1, 20) AS title, text FROM benchmark), o AS ({_OFFICIAL}), exact AS (SELECT unit_id, official_id, 'exact' AS how FROM u JOIN o USING (title, text)),
loose AS (SELECT unit_id, official_id, 'normalized' AS how FROM u JOIN o ON lower({_NORMAL.format('u.title')}) = lower({_NORMAL.format('o.title')}) AND {_NORMAL.format('u.text')} = {_NORMAL.format('o.text')} WHERE unit_id NOT IN (SELECT unit_id FROM exact)),
both_ AS (SELECT * FROM exact UNION ALL SELECT * FROM loose)
SELECT unit_id, official_id, CASE WHEN count(*) OVER (PARTITION BY unit_id) = 1 AND count(*) OVER (PARTITION BY official_id) = 1 THEN how ELSE 'ambiguous' END AS how FROM both_""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages against an edition of them in which every third is set in another way."""
    passages = table(spark, sf_dir, "benchmark")
    units = passages.select(F.col("item_id").alias("unit_id"), F.substring("text", 1, 20).alias("title"), "text")
    third = F.col("item_id") % 3 == 0
    title, body = F.substring("text", 1, 20), F.col("text")
    official = passages.select((F.col("item_id") + 100000).alias("unit_id"), F.when(third, F.upper(title)).otherwise(title).alias("title"), F.when(third, F.concat(F.lit("  "), F.replace(body, F.lit(" "), F.lit("  ")))).otherwise(body).alias("text"))
    return corpus.reconcile(units, official)


@query("j4_excluded", "SELECT doc_id AS unit_id, source AS title FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND lower(source) NOT IN (SELECT lower(source) FROM documents GROUP BY source HAVING count(*) < (SELECT count(*) FROM documents) / 20)")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of rare sources and labelled documents dropped."""
    records = _docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.col("source").alias("title"))
    rare = records.groupBy("title").agg(F.count("*").alias("n")).where(F.col("n") < records.count() / 20)
    return corpus.excluded(records, rare.select("title"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_id")))


@query("s14_rederived_ids", "SELECT count(*) FILTER (doc_id % 7 = 0) AS wrong FROM documents")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stored ids, those of every seventh document spoilt, the ones that content does not give."""
    own = fn.content_id(F.col("source"), F.col("text"))
    units = _docs(spark, sf_dir).withColumn("unit_id", F.when(F.col("doc_id") % 7 == 0, F.concat(own, F.lit("x"))).otherwise(own))
    return summaries.wrong_ids(units, "unit_id", "source", "text").agg(F.count("*").alias("wrong"))


@query("p16_answerable", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Z][a-z]{3,}')) > 0")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})")).alias("evidence"))
    return listed.where(F.size("evidence") > 0).select("doc_id")


@query("p17_level_filter", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", "toxic")


@query("m12_token_total", "SELECT sum(len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS tokens FROM documents")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.tokens(spark, sf_dir).agg(F.sum("n_tokens").alias("tokens"))


@query("k5_disjoint_samples", "SELECT doc_id, CASE WHEN r <= 20 THEN 'dev' WHEN r <= 50 THEN 'test' ELSE 'probe' END AS sample FROM (SELECT doc_id, row_number() OVER (ORDER BY sha1('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 60")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.disjoint_samples(_docs(spark, sf_dir), "doc_id", {"dev": 20, "test": 30, "probe": 10})


@query("k6_lowest_ids", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.lowest_ids(_docs(spark, sf_dir), "doc_id", 50).select("doc_id", "lang")


@query("k8_top_coactivations", f"WITH {graphs._PARTS} SELECT node_id, other_id, units, row_number() OVER (PARTITION BY node_id ORDER BY units DESC, other_id) AS rank FROM (SELECT a.node_id, b.node_id AS other_id, count(*) AS units FROM x a JOIN x b ON a.unit_id = b.unit_id AND a.node_id <> b.node_id GROUP BY ALL) QUALIFY rank <= 5")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.top_coactivations(concepts.coactivation(graphs._parts(spark, sf_dir)[0], best=5), 5)


@query("r11_width_check", "SELECT vec_id AS unit_id, len(embedding) AS width FROM embeddings")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.checked_width(inputs.vectors(spark, sf_dir), 64).select("unit_id", F.size("v").cast("long").alias("width"))


@query("a11_latency_summary", "SELECT l_returnflag AS system, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.95), 6) AS p95, max(l_quantity) AS longest FROM lineitem GROUP BY 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by return flag stand for seconds by system."""
    return summaries.latency(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("system"), "l_quantity"), "system", "l_quantity")


def _hop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    incidence = inputs.orders_parts(spark, sf_dir)
    p1 = inputs.order_queries(incidence)
    return incidence, p1, stored(graph.node_hop(p1, incidence), "hop")


_ORDER_HOP = f"WITH {sql.ORDERS} {sql.order_hop('hop', 'seeds')}"


@query("a12_candidate_summary", _ORDER_HOP + ", per AS (SELECT p1.qid, coalesce(max(positives), 0) AS positives FROM p1 LEFT JOIN hop ON hop.qid = p1.qid GROUP BY p1.qid) SELECT count(*) AS questions, round(quantile_cont(positives, 0.5), 6) AS p50, round(quantile_cont(positives, 0.95), 6) AS p95, max(positives) AS most, round(avg(CASE WHEN positives = 0 THEN 1.0 ELSE 0 END), 9) AS zero_share, (SELECT count(*) FROM hop WHERE unit_id % 10 = 0) AS gold_introduced FROM per")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key ends in zero stand for gold."""
    _, p1, hop = _hop(spark, sf_dir)
    positives = p1.select("qid").join(hop.groupBy("qid").agg(F.max("positives").alias("positives")), "qid", "left").fillna(0)
    return summaries.candidates(positives, hop.where("unit_id % 10 = 0").select("qid", F.lit(1).alias("gold")))


@query("a10_cohort_metrics", _ORDER_HOP + ", per AS (SELECT p1.qid, count(hop.unit_id) AS n FROM p1 LEFT JOIN hop ON hop.qid = p1.qid GROUP BY p1.qid) SELECT cohort, count(*) AS questions, sum(CAST(n >= 50 AS INTEGER)) AS supported, round(avg(n / 100.0), 9) AS recall FROM (SELECT n, unnest(['standard', CASE WHEN o_orderstatus = 'O' THEN 'historical' ELSE 'unseen' END]) AS cohort FROM per JOIN orders ON o_orderkey = qid) GROUP BY cohort")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p1, hop = _hop(spark, sf_dir)
    n = p1.select("qid").join(hop.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").fillna(0)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), "o_orderstatus").join(p1.select("qid"), "qid")
    outcomes = n.select("qid", (F.col("n") >= 50).cast("int").alias("success"), (F.col("n") / 100).alias("recall"))
    return summaries.by_cohort(outcomes, corpus.cohorts(orders.select("qid"), orders.where("o_orderstatus = 'O'").select("qid")))


@query("u6_bridge_nodes", _ORDER_HOP + " SELECT DISTINCT s.qid, s.node_id FROM seeds s JOIN hop ON hop.qid = s.qid AND hop.rank = 1 JOIN incidence i ON i.unit_id = hop.unit_id AND i.node_id = s.node_id")
def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidence, p1, hop = _hop(spark, sf_dir)
    return summaries.bridges(p1, hop.where("rank = 1").select("qid", "unit_id"), incidence)


@query("q6_list_mismatches", f"WITH {sql.ORDERS} {sql.order_hop('hop', 'seeds')} {sql.order_hop('capped', '(SELECT * FROM seeds WHERE df <= 30)')}, a AS (SELECT qid, unit_id FROM hop WHERE rank <= 10), b AS (SELECT qid, unit_id FROM capped WHERE rank <= 10) SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the list under a cap of 30 units a node leaves the list without one."""
    incidence, p1, hop = _hop(spark, sf_dir)
    first = lambda hits: hits.where("rank <= 10").select("qid", "unit_id")
    return paired.same_rows(first(hop), first(graph.node_hop(p1, incidence, df_cap=30)))


#: Lines of an order as sentences: a part is located in the sentence of its line number modulo three, its relevance the largest quantity there.
_LOCATED = "located AS (SELECT l_orderkey AS qid, l_linenumber % 3 AS sentence, l_linenumber AS offset_, l_partkey AS node_id, l_quantity AS q FROM lineitem WHERE l_orderkey % 100 = 0), rel AS (SELECT qid, sentence, max(q) AS rel FROM located GROUP BY ALL)"


def _located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 100 = 0")
    located = lines.select(F.col("l_orderkey").alias("qid"), (F.col("l_linenumber") % 3).alias("sentence"), F.col("l_linenumber").alias("offset"), F.col("l_partkey").alias("node_id"), F.col("l_quantity").alias("q"))
    return located, located.groupBy("qid", "sentence").agg(F.max("q").alias("rel"))


@query("w6_first_mention", f"WITH {_LOCATED} SELECT qid, node_id FROM located QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sentence, offset_, node_id) = 1")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.first_mentions(_located(spark, sf_dir)[0])


_SENTENCES = _LOCATED + ", best AS (SELECT qid, sentence FROM rel QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rel DESC, sentence) <= 1), chosen AS (SELECT DISTINCT qid, node_id FROM located JOIN best USING (qid, sentence))"


def _sentence_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    located, relevance = _located(spark, sf_dir)
    return seeds.from_sentences(located.select("qid", "sentence", "node_id"), relevance, 1)


@query("w8_sentence_ranking", f"WITH {_SENTENCES} SELECT qid, node_id FROM chosen")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentence_seeds(spark, sf_dir)


@query("h14_sentence_seeded_hop", f"WITH {sql.ORDERS}, {_SENTENCES}, picked AS (SELECT qid, node_id, w FROM chosen JOIN node_w USING (node_id)) {sql.order_hop('hop', 'picked')} SELECT qid, unit_id, score, positives, rank FROM hop")
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidence = inputs.orders_parts(spark, sf_dir)
    weighted = _sentence_seeds(spark, sf_dir).join(graph.weights(incidence).select("node_id", "w"), "node_id").select("qid", "node_id", "w")
    return graph.seeded_hop(weighted, incidence, inputs.order_queries(incidence))


_WINDOWS = "gate AS (SELECT qid, node_id FROM (SELECT qid, node_id, round(max(q / 50.0), 6) AS score FROM located GROUP BY ALL) JOIN node_w USING (node_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, w DESC, node_id) <= 2)"


@query("h15_window_seeded_hop", f"WITH {sql.ORDERS}, {_LOCATED}, {_WINDOWS} {sql.order_hop('hop', '(SELECT s.qid, s.node_id, s.w, g.node_id IS NOT NULL AS g FROM seeds s LEFT JOIN gate g USING (qid, node_id))', 'bool_or(g)')} SELECT qid, unit_id, score, positives, rank FROM hop")
def h15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored over all parts of the order; only orders that share one of the two parts whose lines weigh most."""
    incidence = inputs.orders_parts(spark, sf_dir)
    p1, weights = inputs.order_queries(incidence), graph.weights(incidence)
    windows = _located(spark, sf_dir)[0].select("qid", "node_id", (F.col("q") / 50.0).alias("sim"))
    return graph.gated_hop(graph.seeds_of(p1, incidence, weights), seeds.from_windows(windows, weights, 2), incidence, p1)


@query("q13_locating_coverage", f"WITH {_SENTENCES} SELECT count(*) AS wanted, count(c.node_id) AS located, round(avg(CASE WHEN c.node_id IS NULL THEN 0.0 ELSE 1.0 END), 9) AS share FROM (SELECT DISTINCT qid, node_id FROM located) l LEFT JOIN chosen c USING (qid, node_id)")
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.coverage(_sentence_seeds(spark, sf_dir), _located(spark, sf_dir)[0].select("qid", "node_id"))


_TRIPLE = retrieval._QHOP + """, three AS (SELECT component, qid, unit_id, norm FROM scaled WHERE component <> 'hop' UNION ALL SELECT 'question', qid, unit_id, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 0.0 END FROM qhop WINDOW q AS (PARTITION BY qid))
SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (SELECT qid, unit_id, round(sum(norm * CASE component WHEN 'bm25' THEN 0.5 WHEN 'overlap' THEN 0.3 ELSE 0.2 END), 6) AS score FROM three GROUP BY qid, unit_id) QUALIFY rank <= 100"""


@query("f5_query_aware_triple", _TRIPLE)
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = inputs.bm25(spark, sf_dir)
    lists = fusion.components(bm25=first, overlap=inputs.overlap(spark, sf_dir), question=retrieval._question_hop(spark, sf_dir, first))
    return fusion.weighted(lists, {"bm25": 0.5, "overlap": 0.3, "question": 0.2})


_OF_FIRST = re.sub(r"\b(words|asked|posts|freq|corpus|bm25)\b", r"\1_2", sql.BM25).replace("benchmark", "firsts")


@query("h2_bm25_on_first_text", f"WITH {sql.BM25}, firsts AS (SELECT qid AS item_id, text FROM bm25 JOIN documents ON doc_id = unit_id WHERE rank = 1), {_OF_FIRST.replace('<= 100', '<= 111')} SELECT * FROM (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM bm25_2 WHERE (qid, unit_id) NOT IN (SELECT qid, unit_id FROM bm25 WHERE rank <= 10)) WHERE rank <= 100")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of each question's first document taken as the query, what was read left out."""
    first = stored(inputs.bm25(spark, sf_dir), "bm25")
    docs = _docs(spark, sf_dir)
    texts = first.where("rank = 1").join(docs, F.col("unit_id") == F.col("doc_id")).select("qid", F.col("text").alias("query"))
    near = lexical.bm25(texts, docs, 111)
    return rank.top_k(near.join(first.where("rank <= 10").select("qid", "unit_id"), ["qid", "unit_id"], "left_anti").select("qid", "unit_id", "score"), 100)


_LINES = f"""WITH {sql.LISTS} {sql.GOLD}, sizes AS (SELECT qid, count(*) AS n_gold FROM qrels GROUP BY qid), asked_lines AS (SELECT DISTINCT component AS line FROM scaled),
hits AS (SELECT component AS line, qid, {', '.join(f'sum(CAST(place <= {k} AS INTEGER)) AS h{k}' for k in (2, 5, 10, 20, 100))}, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg FROM scaled JOIN qrels USING (qid, unit_id) GROUP BY ALL)
SELECT line, count(*) AS questions, {', '.join(f'round(avg(coalesce(h{k}, 0) / n_gold), 9) AS recall_{k}' for k in (2, 5, 10, 20, 100))}, round(avg(coalesce(dcg, 0) / (SELECT sum(1 / log2(r + 1)) FROM range(1, 1 + CAST(least(n_gold, 10) AS BIGINT)) t(r))), 9) AS ndcg_10 FROM asked_lines CROSS JOIN sizes LEFT JOIN hits USING (line, qid) GROUP BY line"""


@query("m8_line_metrics", _LINES)
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rank.with_rank(inputs.lists(spark, sf_dir), ("component", "qid")).withColumnRenamed("component", "line")
    return summaries.line_metrics(lines, inputs.qrels(spark, sf_dir))


#: Lines of each supplier: wins are discounts above the tax, losses below it.
_COUNTS = "counts AS (SELECT l_suppkey AS id, count(*) FILTER (l_discount > l_tax) AS b, count(*) FILTER (l_discount < l_tax) AS c, count(*) AS n FROM lineitem GROUP BY 1)"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.sum(c.cast("long"))
    won, lost = F.col("l_discount") > F.col("l_tax"), F.col("l_discount") < F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(number(won).alias("b"), number(lost).alias("c"), F.count("*").alias("n"))


@query("t2_sign_test", f"WITH {_COUNTS} SELECT id, CASE WHEN b + c = 0 THEN 1.0 ELSE round((SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(b, b + c + 1) t(i)), 9) END AS p FROM counts")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("id", F.round(stats.sign_test("b", "c"), 9).alias("p"))


@query("t4_non_inferiority", f"WITH {_COUNTS}, v AS (SELECT *, -0.05 AS d, (2 * n - b + c) * -0.05 - (b + c) AS v, c * 0.05 * 1.05 AS w FROM counts), q AS (SELECT *, (sqrt(greatest(v * v - 8 * n * w, 0)) - v) / (4 * n) AS q FROM v) SELECT id, round((b - c - n * d) / sqrt(n * (2 * q + d * (1 - d))), 6) AS z, (b - c - n * d) / sqrt(n * (2 * q + d * (1 - d))) > {stats.Z95} AS not_worse FROM q")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = stats.tango_score("b", "c", "n", F.lit(-0.05))
    return _counts(spark, sf_dir).withColumn("z", z).select("id", F.round("z", 6).alias("z"), (F.col("z") > stats.Z95).alias("not_worse"))


@query("t9_resolvable_margin", f"WITH {_COUNTS} SELECT id, round(sqrt(b / n * (1 - b / n) / n), 9) AS margin FROM counts")
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("id", F.round(stats.standard_error(F.col("b") / F.col("n"), F.col("n")), 9).alias("margin"))


@query("t8_screen_verdict", f"WITH {_COUNTS} SELECT id, CASE WHEN n > 0 AND 100 * (b - greatest(c, n - b - c)) >= 5 * n THEN 'pass' ELSE 'stop' END AS verdict FROM counts")
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = _counts(spark, sf_dir).select("id", F.col("b").alias("w"), F.col("c").alias("t1"), (F.col("n") - F.col("b") - F.col("c")).alias("t2"), "n")
    return paired.screen_verdict(tally).select("id", "verdict")


@query("t6_gate", f"WITH {_COUNTS}, g AS (SELECT id, b > c AS p, b % 2 = 0 AS q, c % 2 = 0 AS r, n % 2 = 0 AS s FROM counts), o AS (SELECT *, CASE WHEN p AND q THEN 'GO' WHEN r THEN 'NAMES_ONLY' ELSE 'STOP' END AS outcome FROM g) SELECT id, outcome, outcome = 'STOP' AND (p OR s) AS anomaly FROM o")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = lambda c: F.col(c) % 2 == 0
    marks = {"both_beat_comparator": F.col("b") > F.col("c"), "both_beat_entities": even("b"), "entities_beat_comparator": even("c"), "concepts_beat_comparator": even("n")}
    return paired.gate(_counts(spark, sf_dir).withColumns(marks)).select("id", "outcome", "anomaly")


@query("t15_dev_gate", f"WITH {_COUNTS} SELECT id, CASE WHEN b >= ceil(c * 0.9) THEN 'go' ELSE 'stop' END AS gate FROM counts")
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.dev_gate(_counts(spark, sf_dir), "b", F.ceil(F.col("c") * 0.9)).select("id", "gate")


@query("t16_contamination", f"WITH {_COUNTS} SELECT id, CASE WHEN abs(100 * (b / n - c / n)) <= 5.0 THEN 'clean' ELSE 'stop' END AS verdict FROM counts")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _counts(spark, sf_dir).select("id", F.col("b").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("b"), F.col("n").alias("n_b"))
    return verdicts.contamination(shares).select("id", "verdict")


@query("t17_latency_verdict", "SELECT l_suppkey AS id, CASE WHEN avg(l_quantity) / 27 > 1.0 THEN 'stop' WHEN avg(l_quantity) / 27 >= 0.8 THEN 'columnwise' ELSE 'rowwise' END AS verdict FROM lineitem GROUP BY 1")
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.avg("l_quantity") / 27).alias("mean_s"))
    return verdicts.latency(mean).select("id", "verdict")


@query("t12_extractor_choice", "SELECT id FROM (SELECT l_suppkey AS id, sum(l_quantity) AS headline, count(*) AS hop, round(sum(l_tax), 6) AS usd, round(sum(l_discount), 6) AS hours FROM lineitem GROUP BY 1) WHERE headline >= ceil((SELECT max(h) FROM (SELECT sum(l_quantity) AS h FROM lineitem GROUP BY l_suppkey)) * 80 / 100) AND hop >= 1 ORDER BY usd, hours, headline DESC, id LIMIT 1")
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as extractors: those that keep four fifths of the largest quantity, the one with the least tax."""
    offers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("headline"), F.count("*").alias("hop"), F.round(F.sum("l_tax"), 6).alias("usd"), F.round(F.sum("l_discount"), 6).alias("hours"))
    best = offers.agg(F.max("headline").alias("best"))
    bars = offers.crossJoin(F.broadcast(best)).withColumns({"headline_bar": verdicts.retention_bar(F.col("best"), 80), "hop_bar": F.lit(1)})
    return verdicts.extractor_choice(bars).select("id")


@query("t19_reproduction", "WITH a AS (SELECT doc_id AS qid, n_chars AS x FROM documents), b AS (SELECT doc_id AS qid, length(text) AS y FROM documents WHERE doc_id % 50 <> 0) SELECT count(*) AS questions, sum(CAST(x IS NULL OR y IS NULL AS INTEGER)) AS unmatched, sum(CAST(abs(x - y) > 1e-5 AS INTEGER)) AS differing, max(abs(x - y)) AS largest, CASE WHEN sum(CAST(x IS NULL OR y IS NULL AS INTEGER)) = 0 AND sum(CAST(abs(x - y) > 1e-5 AS INTEGER)) = 0 THEN 'reproduced' ELSE 'differs' END AS verdict FROM a FULL JOIN b USING (qid)")
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded lengths against counted ones, every fiftieth left out."""
    docs = _docs(spark, sf_dir)
    recorded = docs.select(F.col("doc_id").alias("qid"), F.col("n_chars").alias("value"))
    return verdicts.reproduction(recorded, docs.where("doc_id % 50 <> 0").select(F.col("doc_id").alias("qid"), F.length("text").cast("long").alias("value")))


@query("t20_comparability", "SELECT count(DISTINCT source) AS source, count(DISTINCT lang) AS lang, count(DISTINCT source) <= 1 AND count(DISTINCT lang) <= 1 AS comparable FROM documents")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.comparable(_docs(spark, sf_dir), "source", "lang")


@query("t21_frozen_first", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before >= ts")
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's earlier event stands for the freezing of an event's parameters."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    runs = table(spark, sf_dir, "events").select("event_id", before.alias("frozen_at"), F.col("ts").alias("measured_at"))
    return verdicts.frozen_first(runs).select("event_id")


@query("p20_l2_normalised", "SELECT vec_id AS unit_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS first, round(embedding[64] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS last FROM embeddings")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = inputs.vectors(spark, sf_dir).select("unit_id", vector.l2_normalized(F.col("v")).alias("v"))
    return unit.select("unit_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


#: Hop cells by the number of gate nodes, and weights of the order hop against them.
_GATES, _SHARES = (1, 2, 4), (0.0, 0.25, 0.5, 0.75, 1.0)
_CELLS = f"""WITH {sql.ORDERS}, {_LOCATED}, nearest AS (SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, w DESC, node_id) AS place FROM (SELECT qid, node_id, round(max(q / 50.0), 6) AS score FROM located GROUP BY ALL) JOIN node_w USING (node_id)),
cells(m) AS (VALUES {", ".join(f"({m})" for m in _GATES)}), shares(share) AS (VALUES {", ".join(f"(CAST({a} AS DOUBLE))" for a in _SHARES)}),
scored AS (SELECT m, s.qid, i.unit_id, round(sum(w), 6) AS score FROM seeds s JOIN incidence i USING (node_id) CROSS JOIN cells LEFT JOIN nearest n ON n.qid = s.qid AND n.node_id = s.node_id WHERE i.unit_id <> s.qid GROUP BY ALL HAVING bool_or(coalesce(n.place <= m, false))),
lists AS (SELECT *, row_number() OVER (PARTITION BY m, qid ORDER BY score DESC, unit_id) AS rank FROM scored),
gated AS (SELECT m, qid, unit_id, CASE WHEN max(score) OVER l > min(score) OVER l THEN (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) ELSE 0.0 END AS norm FROM lists WHERE rank <= 100 WINDOW l AS (PARTITION BY m, qid))
{sql.order_hop('hop', 'seeds')}, plain AS (SELECT qid, unit_id, CASE WHEN max(score) OVER l > min(score) OVER l THEN (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) ELSE 0.0 END AS norm FROM hop WINDOW l AS (PARTITION BY qid)),
mixed AS (SELECT m, share, qid, unit_id, sum(part) AS score FROM (SELECT m, share, qid, unit_id, (1 - share) * norm AS part FROM gated, shares UNION ALL SELECT m, share, qid, unit_id, share * norm FROM plain, shares, cells) GROUP BY ALL),
first AS (SELECT *, row_number() OVER (PARTITION BY m, share, qid ORDER BY round(score, 6) DESC, unit_id) AS rank FROM mixed)
SELECT m, share, count(*) AS listed, count(*) FILTER (unit_id % 10 = 0) AS found FROM first WHERE rank <= 10 GROUP BY m, share"""


@query("x7_gate_grid", _CELLS)
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of gate sizes and fusion weights; orders whose key ends in zero stand for gold."""
    incidence, p1, hop = _hop(spark, sf_dir)
    weights = graph.weights(incidence)
    windows = stored(_located(spark, sf_dir)[0].select("qid", "node_id", (F.col("q") / 50.0).alias("sim")), "windows")
    nodes = stored(graph.seeds_of(p1, incidence, weights), "seeds")
    gated = [graph.gated_hop(nodes, seeds.from_windows(windows, weights, m), incidence, p1).select(F.lit(m).alias("m"), "qid", "unit_id", "score") for m in _GATES]
    both = stored(rank.min_max(gated[0].unionByName(gated[1]).unionByName(gated[2]), ("m", "qid")), "gated")
    shares = F.explode(F.array(*(F.lit(a) for a in _SHARES)))
    cells = F.explode(F.array(*(F.lit(m) for m in _GATES)))
    parts = both.select("m", "qid", "unit_id", "norm", shares.alias("share")).select("m", "share", "qid", "unit_id", ((1 - F.col("share")) * F.col("norm")).alias("part"))
    plain = rank.min_max(hop.select("qid", "unit_id", "score")).select("qid", "unit_id", "norm", cells.alias("m")).select("m", "qid", "unit_id", "norm", shares.alias("share"))
    parts = parts.unionByName(plain.select("m", "share", "qid", "unit_id", (F.col("share") * F.col("norm")).alias("part")))
    mixed = parts.groupBy("m", "share", "qid", "unit_id").agg(rank.rounded(F.sum("part")).alias("score"))
    first = rank.top_k(mixed, 10, ("m", "share", "qid"))
    return first.groupBy("m", "share").agg(F.count("*").alias("listed"), F.sum((F.col("unit_id") % 10 == 0).cast("long")).alias("found"))


#: The caps of the grid over document frequency.
_CAPS = (10, 30, 50, 100)


@query("x5_cap_grid", f"WITH {sql.ORDERS}, caps(cap) AS (VALUES {', '.join(f'({c})' for c in _CAPS)}), scored AS (SELECT cap, qid, unit_id, round(sum(w), 6) AS score FROM seeds JOIN incidence USING (node_id), caps WHERE df <= cap AND qid <> unit_id GROUP BY ALL), first AS (SELECT *, row_number() OVER (PARTITION BY cap, qid ORDER BY score DESC, unit_id) AS rank FROM scored) SELECT cap, count(*) AS listed, count(*) FILTER (unit_id % 10 = 0) AS found FROM first WHERE rank <= 100 GROUP BY cap")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and gold found under each cap of the nodes' document frequency."""
    incidence = inputs.orders_parts(spark, sf_dir)
    p1 = inputs.order_queries(incidence)
    lists = None
    for cap in _CAPS:
        own = graph.node_hop(p1, incidence, df_cap=cap).select(F.lit(cap).alias("cap"), "unit_id")
        lists = own if lists is None else lists.unionByName(own)
    return lists.groupBy("cap").agg(F.count("*").alias("listed"), F.sum((F.col("unit_id") % 10 == 0).cast("long")).alias("found"))


@query("c11_diagnostics", f"""WITH {graphs._PARTS}, per_unit AS (SELECT avg(d) AS active_mean, quantile_cont(d, 0.5) AS active_median, max(d) AS active_max, count(*) AS used_units FROM (SELECT count(*) AS d FROM x WHERE w <> 0 GROUP BY unit_id)),
per_node AS (SELECT avg(d) AS units_mean, quantile_cont(d, 0.5) AS units_median, max(d) AS units_max, count(*) AS used_nodes FROM (SELECT count(*) AS d FROM x WHERE w <> 0 GROUP BY node_id))
SELECT round(active_mean, 9) AS active_mean, active_median, active_max, used_units, round(units_mean, 9) AS units_mean, units_median, units_max, used_nodes, (SELECT count(*) FROM part) AS n_units, (SELECT count(*) FROM supplier) - used_nodes AS dead_atoms, (SELECT count(*) FROM part) - used_units AS orphan_units FROM per_unit, per_node""")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units and suppliers as atoms: how many of either the lines of orders use."""
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"))
    found = concepts.diagnostics(graphs._parts(spark, sf_dir)[0], units, table(spark, sf_dir, "supplier").count())
    return found.withColumns({name: F.round(name, 9) for name in ("active_mean", "units_mean")})


@query("a14_same_article", _ORDER_HOP + " SELECT a.o_orderpriority = b.o_orderpriority AS same_article, count(*) AS gold, count(DISTINCT qid) AS questions FROM hop JOIN orders a ON a.o_orderkey = unit_id JOIN orders b ON b.o_orderkey = qid WHERE rank <= 10 AND unit_id % 10 = 0 GROUP BY 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' priorities stand for articles, orders whose key ends in zero for gold."""
    hop = _hop(spark, sf_dir)[2]
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("article"))
    return verdicts.same_article(hop.where("rank <= 10 AND unit_id % 10 = 0").select("qid", "unit_id", F.col("qid").alias("p1")), articles)


@query("a15_repeated_fact", _ORDER_HOP + ", told AS (SELECT qid, unit_id, rank, o_custkey % 100 AS fact FROM hop JOIN orders ON o_orderkey = unit_id) SELECT count(*) AS gold, count(DISTINCT qid) AS questions FROM told g WHERE rank > 10 AND unit_id % 10 = 0 AND EXISTS (SELECT 1 FROM told h WHERE h.qid = g.qid AND h.rank <= 10 AND h.fact = g.fact)")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundredths of the customers stand for facts, orders whose key ends in zero for gold."""
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 100).alias("fact"))
    told = stored(_hop(spark, sf_dir)[2].join(facts, "unit_id").select("qid", "unit_id", "rank", "fact"), "told")
    context, gold = told.where("rank <= 10"), told.where("unit_id % 10 = 0")
    holders = gold.select("qid", "fact", F.col("unit_id").alias("gold_id")).join(context, ["qid", "fact"]).select("qid", "gold_id", "unit_id")
    return verdicts.repeated_fact(context.select("qid", "unit_id"), holders, gold.select("qid", "unit_id"))


#: The decision of each state (s, v, n) of the query below.
_RULES = [(s, v, n, "replace" if s and v else "extend" if s and n else "keep" if n else "stop") for s in (True, False) for v in (True, False) for n in (True, False)]


@query("t7_state_decision", f"WITH {_COUNTS}, rules(s, v, n, decision) AS (VALUES {', '.join(str(r) for r in _RULES)}) SELECT id, decision FROM (SELECT id, b > c AS s, b % 2 = 0 AS v, c % 2 = 0 AS n FROM counts) JOIN rules USING (s, v, n)")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _counts(spark, sf_dir).select("id", (F.col("b") > F.col("c")).alias("s"), (F.col("b") % 2 == 0).alias("v"), (F.col("c") % 2 == 0).alias("n"))
    return verdicts.state_decision(states, spark.createDataFrame(_RULES, "s boolean, v boolean, n boolean, decision string")).select("id", "decision")


@query("t18_scale_outcome", "WITH sizes AS (SELECT l_linenumber AS size, round(avg(l_discount), 6) AS a, round(avg(l_tax), 6) AS b FROM lineitem GROUP BY 1), ends AS (SELECT min_by(a, size) AS a0, min_by(b, size) AS b0, max_by(a, size) AS a1, max_by(b, size) AS b1 FROM sizes) SELECT *, CASE WHEN (a0 - b0) * (a1 - b1) < 0 THEN 'crossover' WHEN a1 < a0 AND b1 < b0 THEN 'both_degrade' WHEN abs(a1 - b1) < abs(a0 - b0) THEN 'convergence' ELSE 'stable_ranking' END AS outcome FROM ends")
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers stand for sizes, mean discount and tax for the two systems."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("size")).agg(F.round(F.avg("l_discount"), 6).alias("a"), F.round(F.avg("l_tax"), 6).alias("b"))
    return grids.scale_outcome(sizes)
