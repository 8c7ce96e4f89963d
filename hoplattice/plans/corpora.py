"""Queries: corpus engineering and text functions over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplattice.functions import text as fn
from hoplattice.operators import corpus, ordered, pack, rank
from hoplattice.plans import inputs
from hoplattice.sources import files
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


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("p1_content_id", "SELECT doc_id, substr(sha1(source || chr(10) || text), 1, 16) AS unit_id FROM documents")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fn.content_id(F.col("source"), F.col("text")).alias("unit_id"))


@query("a3_pool_dedupe", "SELECT substr(sha1(source || chr(10) || text), 1, 16) AS unit_id, any_value(source) AS title, sha256(any_value(text)) AS text_sha, count(*) AS copies FROM documents GROUP BY 1")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pooled(_docs(spark, sf_dir), "source", "text").select("unit_id", "title", F.sha2("text", 256).alias("text_sha"), "copies")


@query("s13_first_occurrence", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY substr(sha1(source || chr(10) || text), 1, 16) ORDER BY doc_id) = 1")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _docs(spark, sf_dir).select("doc_id", "source", fn.content_id(F.col("source"), F.col("text")).alias("unit_id"))
    return corpus.first_occurrence(keyed, "unit_id", "doc_id").select("doc_id", "source")


@query("k4_hash_split", "SELECT item_id, CASE WHEN row_number() OVER (ORDER BY sha1('42:' || item_id), item_id) <= 20 THEN 'dev' ELSE 'test' END AS split FROM benchmark")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.hash_split(table(spark, sf_dir, "benchmark"), "item_id", 20).select("item_id", "split")


@query("p2_hash_subset", "SELECT item_id, sha1('42:' || item_id) AS order_key FROM benchmark ORDER BY 2, 1 LIMIT 10")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.hash_subset(table(spark, sf_dir, "benchmark"), "item_id", 10).select("item_id", "order_key")


@query("p3_order_prefix", "SELECT doc_id, sha256('42' || chr(10) || source || chr(10) || text) AS order_key FROM documents ORDER BY 2, 1 LIMIT 200")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _docs(spark, sf_dir).select("doc_id", fn.salted_order_key(F.col("source"), F.col("text")).alias("order_key"))
    return keyed.orderBy("order_key", "doc_id").limit(200)


@query("a17_near_duplicates", "SELECT source AS title, sha256(substr(text, 1, 80)) AS opening_sha, count(*) AS units FROM documents GROUP BY source, substr(text, 1, 80) HAVING count(*) > 1")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.near_duplicate_groups(_docs(spark, sf_dir), "source", "text").select("title", F.sha2("opening", 256).alias("opening_sha"), "units")


@query("p10_paragraphs", r"""WITH l AS (SELECT doc_id, generate_subscripts(ps, 1) AS line, unnest(ps) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
t AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS txt, before + length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11))) AS start FROM o)
SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS position, sha256(txt) AS text_sha, CAST(start AS BIGINT) AS start, CAST(start + length(txt) AS BIGINT) AS "end" FROM t WHERE txt <> ''""")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.paragraphs(_docs(spark, sf_dir), "doc_id", "text").select("id", "position", F.sha2("text", 256).alias("text_sha"), "start", "end")


@query("p11_fact_locate", r"""WITH l AS (SELECT doc_id, generate_subscripts(ps, 1) AS line, unnest(ps) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
t AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS txt, before + length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11))) AS ps FROM o),
p AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS position, ps, ps + length(txt) AS pe FROM t WHERE txt <> ''),
f AS (SELECT d.doc_id, item_id, strpos(d.text, b.text) - 1 AS s, length(b.text) AS n, length(b.text) - length(ltrim(b.text, ' ')) AS lead FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT doc_id AS id, item_id AS fact_id, s AS start, max(position) FILTER (ps <= s + lead AND s + lead < pe) AS position, count(*) AS touched FROM f JOIN p USING (doc_id) WHERE ps < s + n AND pe > s GROUP BY ALL""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), F.col("text").alias("fact"))
    return corpus.located_facts(facts, _docs(spark, sf_dir)).select("id", "fact_id", "start", "position", "touched")


@query("p21_token_counts", "SELECT doc_id AS unit_id, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n_tokens FROM documents")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.token_counts(_docs(spark, sf_dir))


@query("p5_collapsed_text", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS text_sha FROM documents")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(fn.collapsed(F.col("text")), 256).alias("text_sha"))


@query("p6_node_forms")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of all capitalised words; accents and case folding are beyond SQL and are tested on worked pairs."""
    forms = inputs.entities(spark, sf_dir).select(F.col("node_id").alias("surface")).distinct()
    return forms.select("surface", fn.node_forms("surface").alias("form"))


@query("a18_over_window", "SELECT source, count(*) AS units, sum(CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) > 512 AS INTEGER)) AS over_window, sum(CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) < 20 AS INTEGER)) AS boilerplate FROM documents GROUP BY source")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count("text", F.lit("[A-Za-z0-9]+"))
    counted = _docs(spark, sf_dir).select("source", n.alias("n"))
    return counted.groupBy("source").agg(F.count("*").alias("units"), F.sum((F.col("n") > 512).cast("int")).alias("over_window"), F.sum((F.col("n") < 20).cast("int")).alias("boilerplate"))


@query("a8_distribution", "SELECT source, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.05), 6) AS p5, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS longest FROM (SELECT source, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM documents) GROUP BY source")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _docs(spark, sf_dir).select("source", F.regexp_count("text", F.lit("[A-Za-z0-9]+")).alias("n"))
    return counted.groupBy("source").agg(
        F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.5), 6).alias("median"), F.round(F.percentile("n", 0.05), 6).alias("p5"), F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").cast("long").alias("longest")
    )


@query("s25_shards", "SELECT CAST((rn - 1) // 100 AS BIGINT) AS shard, min(unit_id) AS first, max(unit_id) AS last, count(*) AS n FROM (SELECT doc_id AS unit_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1")
def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shards(_docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id")), 100)


@query("j10_token_coverage", "SELECT (SELECT sum(CAST(l.doc_id IS NULL AS INTEGER)) FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS doubled")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"))
    return corpus.token_coverage(units, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_id")))


@query("u7_cohorts", "SELECT doc_id AS qid, unnest(['standard', CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'historical' ELSE 'unseen' END]) AS cohort FROM documents")
def u7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.cohorts(_docs(spark, sf_dir).select(F.col("doc_id").alias("qid")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid")))


@query("s23_newest_result", "SELECT conv_id, role, max(turn) AS turn, sha256(arg_max(text, turn)) AS text_sha FROM conversations GROUP BY conv_id, role")
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.newest(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", F.sha2("text", 256).alias("text_sha"))


_RUNS = f"""WITH lines AS (SELECT source, CAST(doc_id AS VARCHAR) AS line, row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS place FROM documents),
runs AS (SELECT source, place // {ordered.FAN} AS place, sha1(string_agg(line, chr(10) ORDER BY place)) AS line, count(*) AS n FROM lines GROUP BY source, place // {ordered.FAN}),
upper_runs AS (SELECT source, place // {ordered.FAN} AS place, sha1(string_agg(line, chr(10) ORDER BY place)) AS line, sum(n) AS n FROM runs GROUP BY source, place // {ordered.FAN})
SELECT source, sha1(string_agg(line, chr(10) ORDER BY place)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM upper_runs GROUP BY source"""


@query("a22_set_digest", _RUNS)
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.digest_tree(_docs(spark, sf_dir), "source", F.col("doc_id"))
@query("j2_resolve_titles", r"WITH c AS (SELECT item_id AS unit_id, lower(text) AS title FROM benchmark), w AS (SELECT DISTINCT text AS title FROM benchmark), e AS (SELECT title, min(unit_id) AS ei, count(*) AS en FROM c GROUP BY 1), l AS (SELECT lower(trim(regexp_replace(title, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS nm, min(unit_id) AS li, count(*) AS ln FROM c GROUP BY 1) SELECT sha256(w.title) AS title_sha, CASE WHEN en = 1 THEN ei WHEN en IS NULL AND ln = 1 THEN li END AS unit_id, CASE WHEN en = 1 THEN 'exact' WHEN en > 1 THEN 'ambiguous' WHEN ln = 1 THEN 'normalized' WHEN ln > 1 THEN 'ambiguous' ELSE 'unmatched' END AS how FROM w LEFT JOIN e USING (title) LEFT JOIN l ON nm = lower(trim(regexp_replace(w.title, '[ \t\n\r\f\v]+', ' ', 'g'), ' '))")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark")
    held = passages.select(F.col("item_id").alias("unit_id"), F.lower("text").alias("title"))
    found = corpus.resolve_titles(passages.select(F.col("text").alias("title")), held)
    return found.select(F.sha2("title", 256).alias("title_sha"), "unit_id", "how")
