"""Texts whose hashed words cancel out: their cosine is 0 / 0, as in the checking SQL, and comes before all others."""

import math

import duckdb
import pytest

from hoplattice.operators import vector
from hoplattice.plans import stages

QUESTION = "Esly a thwhrend Marten bleeare in the green valley of Torval near Quenby"
FIRST = "Esly a. Marten walks in the green valley near Quenby of Torval.\nthwhrend Torval bleeare. Then Quenby came home."
#: The first ten are left out as read; each node has its own documents beyond these.
DOCUMENTS = [(1, FIRST)] + [(2 + k, f"{('Esly', 'Marten', 'Torval', 'Quenby')[k % 4]} rests here" + " and there" * (k % 3)) for k in range(50)]


def test_cosines_of_cancelled_words_are_undefined(spark):
    texts = spark.createDataFrame([("q", "esly a thwhrend"), ("void", "Esly a"), ("apart", "thwhrend bleeare"), ("none", "..."), ("same", "thwhrend a esly")], "content_id string, text string")
    made = vector.hashed_vectors(texts)
    touched = {r["content_id"]: r["touched"] for r in made.collect()}
    assert len(touched["void"]) == 1 and touched["none"] == []
    ask = lambda q: made.where(f"content_id = '{q}'").selectExpr("content_id AS qid", "v", "touched")
    units = made.selectExpr("content_id AS unit_id", "v", "touched")
    pairs = units.selectExpr("'q' AS qid", "unit_id")
    got = {r["unit_id"]: r["sim"] for r in vector.hashed_cosines(pairs, ask("q"), units).collect()}
    assert math.isnan(got["void"]) and math.isnan(got["apart"]) == bool(set(touched["apart"]) & set(touched["q"])) and got["none"] == 0 and got["same"] == 1
    got = {r["unit_id"]: r["sim"] for r in vector.hashed_cosines(units.selectExpr("'void' AS qid", "unit_id"), ask("void"), units).collect()}
    assert math.isnan(got["q"]) and math.isnan(got["void"]) and got["none"] == 0


@pytest.mark.parametrize("name", ["h14_document_sentence_hop", "h15_document_window_hop"])
def test_hops_over_cancelled_texts_equal_their_sql(spark, tmp_path, name):
    for table, rows, schema in (("documents", DOCUMENTS, "doc_id long, text string"), ("benchmark", [(1, QUESTION)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = sorted(con.execute(stages.ORACLE_SQL[name]).fetchall())
    assert want and sorted(map(tuple, stages.QUERIES[name](spark, str(tmp_path)).collect())) == want
