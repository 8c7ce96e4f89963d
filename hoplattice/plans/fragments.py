"""DuckDB SQL shared by the checking queries, as common table expressions."""

from __future__ import annotations

from hoplattice.operators.lexical import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: Words of documents and benchmark passages, and BM25 of every passage against every document.
TERMS = f"""
words AS (SELECT doc_id AS unit_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS ws FROM documents),
asked AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_STOP}))) AS term FROM benchmark) GROUP BY ALL),
posts AS (SELECT unit_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT unit_id, len(ws) AS dl, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY unit_id, term),
freq AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM words)"""

BM25 = (
    TERMS
    + """,
bm25 AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT qid, unit_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN freq USING (term) JOIN posts USING (term), corpus GROUP BY qid, unit_id) WHERE score > 0 QUALIFY rank <= 100)"""
)

OVERLAP = """,
shared AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT qid, unit_id, round(sum(CAST(CAST(ln(1 + n / (1 + df)) AS FLOAT) AS DOUBLE)), 6) AS score
  FROM asked JOIN freq USING (term) JOIN posts USING (term), corpus GROUP BY qid, unit_id) QUALIFY rank <= 100)"""

#: The entity hop from BM25's first unit over capitalised words.
ENTITIES = """,
incidence AS (SELECT DISTINCT doc_id AS unit_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS node_id FROM documents),
node_w AS (SELECT node_id, count(*) AS df, CAST(CAST(ln(1 + (SELECT count(DISTINCT unit_id) FROM incidence) / (1 + count(*))) AS FLOAT) AS DOUBLE) AS w FROM incidence GROUP BY node_id),
p1 AS (SELECT qid, unit_id FROM bm25 WHERE rank = 1),
seeds AS (SELECT DISTINCT qid, node_id, w, df FROM p1 JOIN incidence USING (unit_id) JOIN node_w USING (node_id)),
hop AS (SELECT qid, unit_id, score, count(*) OVER (PARTITION BY qid) AS positives, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT qid, unit_id, round(sum(w), 6) AS score FROM seeds JOIN incidence USING (node_id) GROUP BY qid, unit_id)
  WHERE score > 0 AND (qid, unit_id) NOT IN (SELECT qid, unit_id FROM bm25 WHERE rank <= 10) QUALIFY rank <= 100)"""

#: The three lists as one table, with min-max scores.
LISTS = (
    BM25
    + OVERLAP
    + ENTITIES
    + """,
lists AS (SELECT 'bm25' AS component, qid, unit_id, score FROM bm25 UNION ALL SELECT 'overlap', qid, unit_id, score FROM shared UNION ALL SELECT 'hop', qid, unit_id, score FROM hop),
scaled AS (SELECT *, CASE WHEN max(score) OVER c > min(score) OVER c THEN (score - min(score) OVER c) / (max(score) OVER c - min(score) OVER c) ELSE 0.0 END AS norm,
  row_number() OVER (PARTITION BY component, qid ORDER BY score DESC, unit_id) AS place FROM lists WINDOW c AS (PARTITION BY component, qid)),
fused AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT qid, unit_id, round(sum(norm * CASE component WHEN 'bm25' THEN 0.5 WHEN 'overlap' THEN 0.3 ELSE 0.2 END), 6) AS score FROM scaled GROUP BY qid, unit_id) QUALIFY rank <= 100),
rrf AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT qid, unit_id, round(sum(1.0 / (60 + place)), 6) AS score FROM scaled GROUP BY qid, unit_id) QUALIFY rank <= 100)"""
)

GOLD = """,
qrels AS (SELECT DISTINCT item_id AS qid, doc_id AS unit_id FROM benchmark JOIN documents d ON contains(d.text, benchmark.text)),
gold AS (SELECT item_id AS qid, (SELECT count(*) FROM qrels WHERE qrels.qid = item_id) AS n_gold FROM benchmark)"""


def packed(name: str, source: str) -> str:
    """Greedy contexts of a list at all budgets: a fold over ranks."""
    return f""",
{name}_cost AS MATERIALIZED (SELECT qid, unit_id, rank, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM {source} JOIN documents ON doc_id = unit_id),
{name}_fold AS (SELECT qid, CAST(budget AS BIGINT) AS budget, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, false AS taken, CAST(NULL AS BIGINT) AS unit_id FROM (SELECT DISTINCT qid FROM {source}), (SELECT unnest([512, 1024, 2048, 4096]) AS budget)
  UNION ALL SELECT f.qid, f.budget, CAST(c.rank AS BIGINT), CAST(CASE WHEN f.used + c.n <= f.budget THEN f.used + c.n ELSE f.used END AS BIGINT), f.used + c.n <= f.budget, c.unit_id
  FROM {name}_fold f JOIN {name}_cost c ON c.qid = f.qid AND c.rank = f.rank + 1),
{name} AS (SELECT qid, budget, CAST(row_number() OVER (PARTITION BY qid, budget ORDER BY rank) - 1 AS INTEGER) AS place, unit_id FROM {name}_fold WHERE taken)"""


def outcomes(name: str, contexts: str) -> str:
    """Context metrics of every question and budget."""
    return f""",
{name} AS (SELECT qid, budget, coalesce(units, 0) AS units, CASE WHEN n_gold > 0 THEN coalesce(found, 0) / n_gold ELSE 0.0 END AS gold_recall,
  CAST(n_gold > 0 AND coalesce(found, 0) = n_gold AS INTEGER) AS full_support, CASE WHEN coalesce(units, 0) > 0 THEN found / units ELSE 0.0 END AS context_precision
  FROM (SELECT qid, n_gold, CAST(budget AS BIGINT) AS budget FROM gold, (SELECT unnest([512, 1024, 2048, 4096]) AS budget)) LEFT JOIN (
    SELECT qid, budget, count(*) AS units, count(qrels.unit_id) AS found FROM {contexts} LEFT JOIN qrels USING (qid, unit_id) GROUP BY qid, budget) USING (qid, budget))"""


#: Orders and parts as units and nodes; the query set is every order whose key is divisible by 100.
ORDERS = """
incidence AS (SELECT DISTINCT l_orderkey AS unit_id, l_partkey AS node_id FROM lineitem),
node_w AS (SELECT node_id, count(*) AS df, CAST(CAST(ln(1 + (SELECT count(DISTINCT unit_id) FROM incidence) / (1 + count(*))) AS FLOAT) AS DOUBLE) AS w FROM incidence GROUP BY node_id),
p1 AS (SELECT DISTINCT unit_id AS qid, unit_id FROM incidence WHERE unit_id % 100 = 0),
seeds AS (SELECT qid, node_id, w, df FROM p1 JOIN incidence USING (unit_id) JOIN node_w USING (node_id))"""


def order_hop(name: str, seeds: str, where: str = "true") -> str:
    return f""",
{name} AS (SELECT qid, unit_id, score, count(*) OVER (PARTITION BY qid) AS positives, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT qid, unit_id, round(sum(w), 6) AS score FROM {seeds} JOIN incidence USING (node_id) GROUP BY qid, unit_id HAVING {where}) WHERE score > 0 AND qid <> unit_id QUALIFY rank <= 100)"""


#: Suppliers and parts as a weighted table.
SUPPLY = """
x AS (SELECT l_suppkey AS unit_id, l_partkey AS node_id, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"""

#: The dense list: vectors whose id is divisible by 100 against all others.
DENSE = """
dense AS (SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM (
  SELECT q.vec_id AS qid, u.vec_id AS unit_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings u ON q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id) QUALIFY rank <= 100)"""
