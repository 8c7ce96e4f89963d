"""Products over candidate pairs, grids as products, mentions, and values stored by content."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoplattice.operators import fusion, graph, grids, mentions, pack, product, rank, vector
from hoplattice.sources.cache import ContentCache, content_key
from hoplattice.sources.tables import Pieces

RNG = np.random.default_rng(31)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_products_are_taken_for_the_given_pairs_only(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 3)
    values = RNG.normal(size=(20, 5))
    units = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(values)], "unit_id long, v array<double>")
    queries = units.where("unit_id < 8").select(F.col("unit_id").alias("qid"), "v")
    pairs = {(q, u) for q in range(9) for u in range(22) if (q * 7 + u) % 3 == 0}  # query 8 and units 20, 21 have no vector
    got = {(r["qid"], r["unit_id"]): r["sim"] for r in vector.sampled_dots(spark.createDataFrame(sorted(pairs), "qid long, unit_id long"), queries, units).collect()}
    assert set(got) == {(q, u) for q, u in pairs if q < 8 and u < 20}
    assert all(abs(s - round(float(values[q] @ values[u]), 6)) < 1e-9 for (q, u), s in got.items())
    assert vector.sampled_dots(spark.createDataFrame([], "qid long, unit_id long"), queries, units).count() == 0


def test_relevance_stage_mixes_whole_candidate_sets(spark):
    """Brute force: 60 units with up to four of 12 nodes, three alphas."""
    nodes = sorted({(u, int(n)) for u in range(60) for n in RNG.integers(0, 12, 4)})
    values = RNG.normal(size=(60, 4))
    units = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(values)], "unit_id long, v array<double>")
    first = spark.createDataFrame([(q, (q * 7 + r) % 60, r) for q in (0, 5, 9) for r in range(1, 13)], "qid long, unit_id long, rank int")
    incidence = spark.createDataFrame(nodes, "unit_id long, node_id long")
    alphas = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "alpha double")
    queries = units.where("unit_id in (0, 5, 9)").select(F.col("unit_id").alias("qid"), "v")
    got = rows(graph.relevance_stage(first, incidence, queries, units, alphas, k=100), "alpha", "qid", "rank", "unit_id", "score")
    df = {n: len({u for u, m in nodes if m == n}) for _, n in nodes}
    w = {n: float(np.float32(np.log(1 + 60 / (1 + d)))) for n, d in df.items()}
    want = []
    for q in (0, 5, 9):
        read = {(q * 7 + r) % 60 for r in range(1, 11)}
        own = {n for u, n in nodes if u == (q * 7 + 1) % 60}
        scores = {}
        for u, n in nodes:
            if n in own and u not in read:
                scores[u] = scores.get(u, 0) + w[n]
        scores = {u: round(s, 6) for u, s in scores.items()}
        sims = {u: round(float(values[q] @ values[u]), 6) for u in scores}
        scaled = lambda m: {u: (x - min(m.values())) / (max(m.values()) - min(m.values())) for u, x in m.items()}
        for alpha in (0.0, 0.5, 1.0):
            a, b = scaled(scores), scaled(sims)
            mixed = scores if alpha == 0 else {u: round((1 - alpha) * a[u] + alpha * b[u], 9) for u in scores}
            want += [(alpha, q, k + 1, u, mixed[u]) for k, u in enumerate(sorted(mixed, key=lambda u: (-mixed[u], u)))]
    assert [g[:4] for g in got] == [v[:4] for v in sorted(want)]


def some_lists(spark, queries=4, units=30):
    out = []
    for q in range(queries):
        for name in ("a", "b", "c"):
            for u in RNG.choice(units, 15, replace=False).tolist():
                out.append((name, q, u, float(np.round(RNG.integers(0, 8) / 7, 3))))
    return spark.createDataFrame(out, "component string, qid long, unit_id long, score double").cache()


def test_grid_products_equal_fusion_point_by_point(spark):
    lists, names = some_lists(spark), ["a", "b", "c"]
    weights = product.weights_of(names)
    assert weights.shape == (3, 66)
    got = rows(product.topk(lists, names, weights, k=7), "point", "qid", "rank", "unit_id", "score")
    for point in (0, 13, 40, 65):
        plain = fusion.weighted(lists, dict(zip(names, weights[:, point].tolist(), strict=True)), k=7)
        assert [g[1:] for g in got if g[0] == point] == rows(plain, "qid", "rank", "unit_id", "score")
    old = fusion.grid(lists, grids.weight_table(spark, names), names, k=7)
    assert got == rows(old, "point", "qid", "rank", "unit_id", "score")


def test_grid_outcomes_equal_the_plain_fill(spark):
    lists, names = some_lists(spark), ["a", "b", "c"]
    weights = product.weights_of(names, 2)
    cost = {u: 10 + 37 * u % 90 for u in range(30)}
    tokens = spark.createDataFrame(sorted(cost.items()), "unit_id long, n_tokens long")
    gold = {(q, u) for q in range(4) for u in range(0, 30, 7)}
    qrels = spark.createDataFrame(sorted(gold), "qid long, unit_id long")
    got = rows(product.outcomes(lists, names, weights, qrels, tokens=tokens, budgets=(120, 400), k=100).fillna(0, ["budget"]), "point", "qid", "budget", "units", "found")
    budgets = spark.createDataFrame([(120,), (400,)], "budget long")
    for point in range(weights.shape[1]):
        fused = fusion.weighted(lists, dict(zip(names, weights[:, point].tolist(), strict=True)))
        filled = rows(pack.fill_contexts(fused, tokens, budgets), "qid", "budget", "unit_id")
        for q in range(4):
            top = [u for k, _, u in rows(fused.where(F.col("qid") == q), "rank", "qid", "unit_id") if k <= 10]
            assert (point, q, 0, len(top), sum((q, u) in gold for u in top)) in got
            for b in (120, 400):
                held = [u for p, c, u in filled if (p, c) == (q, b)]
                assert (point, q, b, len(held), sum((q, u) in gold for u in held)) in got
    with pytest.raises(Exception, match="no token count"):
        product.outcomes(lists, names, weights, qrels, tokens=tokens.where("unit_id <> 3"), budgets=(120,)).collect()


def test_mentions_stand_between_word_bounds(spark):
    said = "Anna met Annabel. Éva saw Anna-Anna again!  \n\n st. louis is not St. Louis\nlast Anna"
    texts = spark.createDataFrame([(1, 10, said, "who is Anna"), (2, 11, "", None), (3, 12, None, "Anna")], "qid long, unit_id long, text string, question string")
    nodes = spark.createDataFrame([(10, 1, "Anna"), (10, 2, "va"), (10, 3, "St"), (10, 4, "gone"), (10, 5, ""), (11, 1, "Anna"), (12, 1, "Anna")], "unit_id long, node_id long, form string")
    got = sorted(((r["qid"], r["node_id"], r["named"], -1 if r["sentence"] is None else r["sentence"], r["offset"], r["window"]) for r in mentions.located(texts, nodes).collect()), key=str)
    assert [g for g in got if g[0] == 1 and g[1] == 1] == [
        (1, 1, True, 0, 0, "met Annabel"), (1, 1, True, 1, 13, "Éva saw again"), (1, 1, True, 1, 8, "Éva saw again"), (1, 1, True, 5, 5, "last"),
    ]
    assert {(g[1], g[3]) for g in got if g[0] == 1 and g[1] > 1} == {(2, -1), (3, 3), (4, -1), (5, -1)}
    assert [g[:4] for g in got if g[0] > 1] == [(2, 1, False, -1), (3, 1, True, -1)]


def test_mentions_equal_a_pattern_for_each_form():
    forms = ["a", "ab", "b a", "ba", "_a"]
    automaton = mentions.automaton_of(iter(forms))
    for _ in range(3_000):
        t = "".join(RNG.choice(list("ab _.é"), 14))
        want = {f: [m.start() for m in re.finditer(rf"(?<!\w){re.escape(f)}(?!\w)", t)] for f in forms}
        assert mentions.find(t, automaton) == {f: s for f, s in want.items() if s}
    assert mentions.automaton_of(iter([""])) is None


def test_values_are_computed_once_for_each_content(spark, tmp_path):
    cache = ContentCache(spark, str(tmp_path), "a model, version 1", "v double", buckets=4)
    texts = spark.createDataFrame([("x",), ("y",), ("x",)], "text string").select(content_key(F.col("text")).alias("content_id"), "text")
    length = lambda df: df.select("content_id", F.length("text").cast("double").alias("v"))
    assert cache.fill(texts, length) == 2 and cache.fill(texts, length) == 0
    more = texts.union(spark.createDataFrame([("zz",)], "text string").select(content_key(F.col("text")), "text"))
    assert cache.fill(more, length) == 1 and cache.table().count() == 3 and cache.conflicts().count() == 0
    assert sorted(r["v"] for r in cache.lookup(more).collect()) == [1.0, 1.0, 1.0, 2.0]
    with pytest.raises(Exception, match="nothing stored"):
        cache.lookup(spark.createDataFrame([("k",)], "content_id string")).collect()
    new = spark.createDataFrame([("q",)], "text string").select(content_key(F.col("text")).alias("content_id"), "text")
    for wrong in (lambda df: length(df).union(length(df)), lambda df: length(df).limit(0)):
        with pytest.raises(ValueError, match="computed twice"):
            cache.fill(new, wrong)
    other = ContentCache(spark, str(tmp_path), "a model, version 2", "v double", buckets=4)
    assert other.table().count() == 0 and other.path != cache.path
    again = ContentCache(spark, str(tmp_path), "a model, version 1", "v double", buckets=4)
    assert again.fill(more, length) == 0


def test_a_lookup_does_not_shuffle_the_cache(spark, tmp_path):
    cache = ContentCache(spark, str(tmp_path), "m", "v double", buckets=4)
    texts = spark.range(400).select(content_key(F.col("id").cast("string")).alias("content_id"))
    cache.fill(texts, lambda df: df.select("content_id", F.lit(1.0).alias("v")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cache.lookup(texts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_pieces_are_one_table(spark):
    pieces = Pieces(spark, "a long", "pieces")
    assert pieces.read().count() == 0
    for k in range(3):
        pieces.add(spark.range(k).select(F.col("id").alias("a")))
    assert rows(pieces.read(), "a") == [(0,), (0,), (1,)]


def test_hashed_vectors_are_unit_vectors(spark):
    got = {r["content_id"]: r["v"] for r in vector.hashed_vectors(spark.createDataFrame([("1", "a b a"), ("2", "A, b! a"), ("3", ""), ("4", None)], "content_id string, text string")).collect()}
    assert got["1"] == got["2"] and abs(np.linalg.norm(got["1"]) - 1) < 1e-12 and not any(got["3"]) and not any(got["4"])


def test_ranges_need_no_window(spark):
    found = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 3, 1.0)], "qid long, unit_id long, score double")
    sims = found.select("qid", "unit_id", F.col("unit_id").cast("double").alias("sim"))
    got = rows(graph.relevance_hop(found, sims, spark.createDataFrame([(0.5,)], "alpha double")), "qid", "rank", "unit_id", "score")
    assert got == [(1, 1, 2, 0.5), (1, 2, 1, 0.0), (2, 1, 3, 0.0)]
    assert rank.top_k(found, 1).count() == 2
