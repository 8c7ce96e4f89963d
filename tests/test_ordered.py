"""Places over ranges, digest trees, nested prefixes, whole orders and the two-tower judge against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoplattice.functions import text
from hoplattice.operators import graph, ordered, rerank, vector, walk

RNG = np.random.default_rng(41)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def vectors(spark, n, name="unit_id", d=4):
    values = RNG.normal(size=(n, d))
    return values, spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(values)], f"{name} long, v array<double>")


def test_places_and_ranks_run_over_ranges(spark):
    table = [(f"g{int(k)}", int(v), i) for i, (k, v) in enumerate(zip(RNG.integers(0, 3, 200), RNG.integers(0, 20, 200), strict=True))] + [("hot", 1, 200 + i) for i in range(150)]
    df = spark.createDataFrame(table, "g string, v long, i long").repartition(5)
    for parts in (1, 7):
        got = {r["i"]: r["place"] for r in ordered.placed(df, F.desc("v"), F.asc("i"), parts=parts).collect()}
        assert [got[i] for _, _, i in sorted(table, key=lambda t: (-t[1], t[2]))] == list(range(350))
        ranks = {r["i"]: r["rank"] for r in ordered.ranked(df, "g", F.desc("v"), F.asc("i"), parts=parts).collect()}
        for g in {t[0] for t in table}:
            own = sorted((t for t in table if t[0] == g), key=lambda t: (-t[1], t[2]))
            assert [ranks[t[2]] for t in own] == list(range(1, len(own) + 1))
    assert ordered.placed(df.limit(0), F.col("i")).count() == 0


def test_node_ids_of_forms_that_begin_alike(spark):
    forms = [("entity", f"Th{k:04d}") for k in range(300)] + [("concept", "a"), ("concept", ""), ("entity", "Th0001")]
    got = rows(graph.node_ids(spark.createDataFrame(forms, "type string, form string")), "node_id", "type", "form")
    assert got == [(k, *f) for k, f in enumerate(sorted({f for f in forms if f[1]}))]


def test_digest_trees_cover_runs(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN", 4)
    table = [("a", k) for k in range(70)] + [("b", 1), ("b", 1), ("c", 12)]
    got = {r["g"]: (r["digest"], r["n"]) for r in ordered.digest_tree(spark.createDataFrame(table, "g string, x long").repartition(3), "g", F.col("x")).collect()}
    sha = lambda lines: hashlib.sha1("\n".join(lines).encode()).hexdigest()
    for g in "abc":
        level = sorted(str(x) for h, x in table if h == g)
        n = len(level)
        for k in range(3):
            level = [sha(level[j : j + 4]) for j in range(0, len(level), 4)] if k < 2 else [sha(level)]
        assert got[g] == (level[0], n)


def test_whole_orders_and_nested_prefixes(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 2)
    values, units = vectors(spark, 60)
    queries = units.where("unit_id in (0, 7, 33)").select(F.col("unit_id").alias("qid"), "v")
    scores = {(q, u): round(float(values[q] @ values[u]), 6) for q in (0, 7, 33) for u in range(60) if u != q}
    order = lambda q, among: sorted((u for u in among if u != q), key=lambda u: (-scores[q, u], u))
    got = rows(vector.full_order(queries, units), "qid", "rank", "unit_id")
    assert got == [(q, k + 1, u) for q in (0, 7, 33) for k, u in enumerate(order(q, range(60)))]
    frozen = sorted(range(60), key=lambda u: (u * 37 % 60, u))
    for sizes in ((5, 20, None), (1, 2, 3), (None,), (80,)):
        found = vector.nested_topk(queries, units.repartition(4), sizes, F.col("unit_id") * 37 % 60, F.col("unit_id"), k=6)
        want = [(s or -1, q, k + 1, u) for s in sizes for q in (0, 7, 33) for k, u in enumerate(order(q, frozen[:s])[:6])]
        assert rows(found.fillna(-1, ["size"]), "size", "qid", "rank", "unit_id") == sorted(want)
    with pytest.raises(ValueError, match="ascend"):
        vector.nested_topk(queries, units, (5, 5), F.col("unit_id"))


def test_two_tower_judge(spark):
    values, units = vectors(spark, 12)
    towers = [RNG.normal(size=(3, 4)) for _ in range(2)]
    pairs = [(q, u) for q in (1, 5) for u in range(12)]
    questions = units.where("unit_id in (1, 5)").select(F.col("unit_id").alias("qid"), "v")
    got = {(r["qid"], r["unit_id"]): r["judge"] for r in rerank.two_tower(spark.createDataFrame(pairs, "qid long, unit_id long"), questions, units, *towers, scale=7.0).collect()}
    z = [values @ t.T / np.linalg.norm(values @ t.T, axis=1, keepdims=True) for t in towers]
    assert got == {(q, u): pytest.approx(7 * float(z[0][q] @ z[1][u]), abs=1e-6) for q, u in pairs}
    broken = units.union(spark.createDataFrame([(99, [float("inf")] * 4)], "unit_id long, v array<double>"))
    with pytest.raises(Exception, match="not finite"):
        rerank.two_tower(spark.createDataFrame([(1, 99)], "qid long, unit_id long"), questions, broken, *towers, scale=1.0).collect()


def test_a_hub_is_dealt_into_rows(spark, monkeypatch):
    monkeypatch.setattr(walk, "EDGES", 16)
    edges = [(1, k, 1.0) for k in range(300)] + [(2, k, 0.5) for k in range(9)]
    packed = walk._packed(spark.createDataFrame(edges, "s long, t long, w double"), "s", "t", F.col("w")).collect()
    hub = [r for r in packed if r["key"] == 1]
    assert len(hub) > 10 and max(len(r["targets"]) for r in hub) < 48 and sorted(t for r in hub for t in r["targets"]) == list(range(300))
    assert len([r for r in packed if r["key"] == 2]) == 1


def test_a_form_is_never_a_pattern(spark):
    forms = [("a\\Eb", "x a\\Eb y", True), ("a\\E.*", "x abc y", False), ("\\E", "\\E", True), ("\\Q.", "z", False), ("a.c", "abc", False), ("st. louis", "in st. louis now", True)]
    df = spark.createDataFrame(forms, "form string, text string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", text.occurs(F.col("form"), F.col("text"))).collect())


def test_bounds_hold_the_true_split(spark):
    """Enumeration: questions with known places; the bounds from totals hold what the places say."""
    runs, truth = {"a": [], "b": [], "d": []}, {"won": [0, 0, 0], "lost": [0, 0, 0]}
    for q in range(400):
        n = int(RNG.integers(1, 6))
        top = RNG.random(n) < 0.5  # gold in the dense list's first ten
        held = RNG.random((2, n)) < 0.7
        held[int(RNG.integers(0, 2))] = True
        for name, mine in zip("ab", held, strict=True):
            units = int(mine.sum() + RNG.integers(0, 4))
            runs[name].append((q, units, float(mine.mean()), int(mine.all()), float(mine.sum() / units) if units else 0.0))
        runs["d"].append((q, float(top.mean())))
        if held[0].all() != held[1].all():
            changed = ~held[1] if held[0].all() else ~held[0]
            t = truth["won" if held[0].all() else "lost"]
            t[0] += int(changed.sum())
            t[1] += int((changed & top).sum())
            t[2] += int((changed & ~top).sum())
    schema = "qid int, units int, gold_recall double, full_support int, context_precision double"
    a, b, d = spark.createDataFrame(runs["a"], schema), spark.createDataFrame(runs["b"], schema), spark.createDataFrame(runs["d"], "qid int, recall_10 double")
    got = {r["outcome"]: r for r in rerank.bounded_rank_split(a, b, d).collect()}
    for outcome, (changed, inside, beyond) in truth.items():
        r = got[outcome]
        assert r["changed"] == changed and r["in_10"] <= inside <= r["in_10"] + r["undetermined"] and r["beyond_10"] <= beyond <= r["beyond_10"] + r["undetermined"]
    assert got["total"]["changed"] == truth["won"][0] + truth["lost"][0] and 0 < got["total"]["undetermined"] < got["total"]["changed"]
    with pytest.raises(Exception, match="lacks question"):
        rerank.bounded_rank_split(a, b.where("qid > 0"), d).collect()


def test_pilots_and_navigation(spark):
    first = spark.createDataFrame([(1, u, u) for u in range(1, 13)] + [(2, u, u) for u in range(1, 13)], "qid long, unit_id long, rank int")
    gold = spark.createDataFrame([(1, 2), (1, 11), (1, 50), (2, 3)], "qid long, unit_id long")
    missing = rerank.pilot(first, gold)
    assert rows(missing, "qid", "p1", "unit_id") == [(1, 1, 11), (1, 1, 50)]
    arms = spark.createDataFrame([("x", 1, 11, 1), ("x", 1, 50, 20), ("y", 1, 2, 1), ("y", 2, 50, 1)], "arm string, qid long, unit_id long, rank int")
    got = rows(rerank.navigation(arms, missing), "arm", "missing", "questions", "found_10", "questions_10", "found_100", "questions_100")
    assert got == [("x", 2, 1, 1, 1, 2, 1), ("y", 2, 1, 0, 0, 0, 0)]


def test_walks_refuse_bad_seeds_and_leave_a_trace(spark):
    x = spark.createDataFrame([("u0", "a", 2.0), ("u1", "a", 1.0), ("u1", "b", 1.0), ("u2", "b", 3.0)], "unit_id string, node_id string, w double")
    seed = lambda *us: spark.createDataFrame([("q", u, 1.0 / len(us)) for u in us], "qid string, unit_id string, mass double")
    for bad, said in ((seed("u0", "gone"), "unknown seed gone"), (seed("u0", "u0"), "twice")):
        with pytest.raises(Exception, match=said):
            walk.walk(bad, x, 0.5)
    trace = walk.new_trace(seed("u0"), x)
    walked = {r["unit_id"]: r["rounds"] for r in walk.walk(seed("u0"), x, 0.5, trace=trace, traced=1).collect()}
    left = rows(trace.read(), "round", "node_id", "rank")
    assert left == [(k, "a", 1) for k in range(1, max(walked.values()) + 1)]
    change = [r["change"] for r in trace.read().orderBy("round").collect()]
    assert change == sorted(change, reverse=True) and change[0] > 0
    one = walk.config_digest(x, 0.5, "symmetric")
    assert len(one) == 16 and one == walk.config_digest(x.repartition(3), 0.5, "symmetric")
    assert len({one, walk.config_digest(x, 0.6, "symmetric"), walk.config_digest(x.withColumn("w", F.col("w") + 1), 0.5, "symmetric")}) == 3
