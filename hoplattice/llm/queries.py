"""The numbered queries: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hoplattice.llm import bpe, embedding_dedup, fingerprints, lm, packing, pii, prefix_trie, secrets, simhash_dedup, token_counts, toxicity, url_filter, whitening
from hoplattice.llm.common import read, stored


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = stored(fingerprints.fingerprint_edits(read(spark, sf_dir, "documents")), "fingerprints")
    return fingerprints.with_neighbours(marked, "doc_id % 100 = 0", radius=3)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), length=2048, end_id=1)


#: The contract's rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=4, radius=4)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(read(spark, sf_dir, "conversations"))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_table(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_lm_scores": op8_lm_scores,
    "op9_token_counts": op9_token_counts,
    "op10_secrets": op10_secrets,
    "op11_pii": op11_pii,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {}
