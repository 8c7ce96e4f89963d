"""Runs of several systems, declared comparisons, hop records, stored lists, question sets, query arms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoplattice.operators import concepts, questions, runs
from hoplattice.sources.results import RunStore

OUTCOME = "system string, qid long, budget long, full_support int, gold_recall double"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def measured(spark, support):
    """``support[system]`` holds a 0 or 1 for each question."""
    return spark.createDataFrame([(s, q, 512, x, float(x)) for s, xs in support.items() for q, x in enumerate(xs)], OUTCOME)


PAIRS = "comparison string, control string, candidate string"


def test_all_declared_comparisons_come_from_one_table(spark):
    support = {"a": [1, 1, 1, 0, 1, 0, 1, 1], "b": [0, 0, 1, 0, 0, 0, 0, 1], "c": [1, 1, 1, 0, 1, 0, 1, 1]}
    pairs = spark.createDataFrame([("a over b", "b", "a"), ("b over a", "a", "b"), ("c over a", "a", "c"), ("a over itself", "a", "a")], PAIRS)
    got = {r["comparison"]: r for r in runs.comparison_set(measured(spark, support), pairs).collect()}
    assert [got["a over b"][c] for c in ("both", "only_a", "only_b", "neither", "n", "better", "worse", "equal")] == [2, 4, 0, 2, 8, 4, 0, 4]
    assert got["a over b"]["recall_difference"] == 0.5 and got["b over a"]["recall_difference"] == -0.5
    assert got["a over b"]["p"] == 0.125 == got["b over a"]["p"]
    assert got["c over a"]["p"] == 1.0 and got["c over a"]["equal"] == 8
    assert got["a over itself"]["both"] == 6 and got["a over itself"]["n"] == 8
    apart = runs.disagreements(measured(spark, support), pairs, per_group=3)
    assert rows(apart, "comparison", "winner", "size", "qid") == [("a over b", "candidate", 4, q) for q in (0, 1, 4)] + [("b over a", "control", 4, q) for q in (0, 1, 4)]


@pytest.mark.parametrize("case", ["one side", "twice", "absent"])
def test_comparisons_refuse_unlike_question_sets(spark, case):
    table = measured(spark, {"a": [1, 0], "b": [1] if case == "one side" else [1, 1]})
    if case == "twice":
        table = table.unionByName(table.where("system = 'a' AND qid = 1"))
    pairs = spark.createDataFrame([("p", "b", "nobody" if case == "absent" else "a")] + ([("q", "nobody", "nobody")] if case == "absent" else []), PAIRS)
    with pytest.raises(Exception, match="side in|no outcomes for"):
        runs.comparison_set(table, pairs).collect()


def test_outcomes_of_systems_equal_each_system_alone(spark):
    lists = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 2, 12, 1), ("b", 1, 11, 1)], "system string, qid long, unit_id long, rank int")
    tokens = spark.createDataFrame([(10, 3), (11, 4), (12, 9)], "unit_id long, n_tokens long")
    budgets = spark.createDataFrame([(4,), (8,)], "budget long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (1, 10)], "qid long, unit_id long")
    filled = runs.contexts(lists, tokens, budgets)
    assert rows(filled, "system", "qid", "budget", "unit_id") == [("a", 1, 4, 10), ("a", 1, 8, 10), ("a", 1, 8, 11), ("b", 1, 4, 11), ("b", 1, 8, 11)]
    got = runs.outcomes(filled, lists.select("system"), asked, gold, budgets)
    assert rows(got.where("budget = 8"), "system", "qid", "units", "gold_recall", "full_support", "context_precision") == [
        ("a", 1, 2, 1.0, 1, 1.0), ("a", 2, 0, 0.0, 0, 0.0), ("a", 3, 0, 0.0, 0, 0.0), ("b", 1, 1, 0.5, 0, 1.0), ("b", 2, 0, 0.0, 0, 0.0), ("b", 3, 0, 0.0, 0, 0.0)
    ]


def hop_tables(spark):
    """Question 1 has a hop of three candidates, 2 one of a single candidate, 3 an empty one and 4 no list at all."""
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    first = spark.createDataFrame([(1, 10, 9.0, 1), (1, 11, 8.0, 2), (1, 12, 7.0, 3), (2, 20, 9.0, 1), (3, 30, 9.0, 1)], "qid long, unit_id long, score double, rank int")
    hop = spark.createDataFrame([(1, 12, 5.0, 7, 1), (1, 13, 2.0, 7, 2), (1, 14, 2.0, 7, 3), (2, 21, 1.0, 1, 1)], "qid long, unit_id long, score double, positives long, rank int")
    nodes = spark.createDataFrame([(10, "x"), (10, "y"), (12, "x"), (13, "x"), (13, "y"), (14, "y"), (20, "z"), (21, "z")], "unit_id long, node_id string")
    fused = spark.createDataFrame([(1, 10, 1), (1, 13, 2), (1, 12, 3), (2, 20, 1), (2, 21, 2), (3, 30, 1)], "qid long, unit_id long, rank int")
    context = spark.createDataFrame([(1, 10), (1, 13), (1, 12), (2, 20), (3, 30)], "qid long, unit_id long")
    return asked, first, hop, nodes, fused, context


def test_hop_record_counts_the_gold_outside_the_first_list(spark):
    asked, first, hop, nodes, fused, context = hop_tables(spark)
    gold = spark.createDataFrame([(1, 13), (1, 14), (1, 12), (1, 99), (2, 21), (4, 40)], "qid long, unit_id long")
    got = runs.hop_record(asked, first, hop, fused, context, gold, nodes)
    names = ("qid", "p1", "p1_nodes", "positives", "proposed", "gold_outside", "gold_proposed", "gold_introduced", "gold_in_context")
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=lambda r: r[0]) == [
        (1, 10, 2, 7, 3, 3, 2, 1, 1), (2, 20, 1, 1, 1, 1, 1, 1, 0), (3, 30, 0, 0, 0, 0, 0, 0, 0), (4, None, 0, 0, 0, 1, 0, 0, 0)
    ]


def test_hop_diagnostics_and_their_summary(spark):
    asked, first, hop, nodes, _, context = hop_tables(spark)
    control = spark.createDataFrame([(1, 10), (1, 50), (1, 51)], "qid long, unit_id long")
    got = runs.hop_diagnostics(asked, first, hop, context, control, nodes, depth=3, read=2)
    names = ("qid", "positives", "size", "bottom_tier", "overlap", "context_beyond", "control_beyond", "reaches_depth", "empty", "single", "abstained")
    assert rows(got, *names) == [(1, 7, 3, 2, 1, 1, 2, 1, 0, 0, 0), (2, 1, 1, 1, 0, 0, 0, 0, 0, 1, 1), (3, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1), (4, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1)]
    total = {r["figure"]: (r["questions"], r["total"], r["least"], r["mean"], r["median"], r["most"]) for r in runs.diagnostics_summary(got).collect()}
    assert total["size"] == (4, 4, 0, 1.0, 0.5, 3) and total["abstained"][1] == 3 and total["empty"][1] == 2


def test_traces_tell_the_hop_from_a_reorder(spark):
    _, first, hop, nodes, fused, context = hop_tables(spark)
    seeds = spark.createDataFrame([(1, "x", 0.5), (1, "y", 2.0), (2, "z", 1.0)], "qid long, node_id string, w double")
    plain = spark.createDataFrame([(1, 10), (2, 20)], "qid long, unit_id long")
    got = {(r["qid"], r["unit_id"]): r for r in runs.traces(first, plain, context, fused, hop, seeds, nodes).collect()}
    assert set(got) == {(1, 12), (1, 13), (3, 30)}
    assert (got[1, 13]["origin"], got[1, 13]["hop_rank"], got[1, 13]["fused_rank"], got[1, 13]["p1"], got[1, 13]["nodes"]) == ("hop", 2, 2, 10, ["y", "x"])
    assert (got[3, 30]["origin"], got[3, 30]["hop_rank"], got[3, 30]["nodes"]) == ("reorder", None, [])


def test_differing_lists(spark):
    schema = "qid long, rank int, unit_id long, score double"
    kept = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.4), (2, 1, 7, None), (3, 1, 8, 0.1)], schema)
    again = spark.createDataFrame([(1, 1, 6, 0.5), (1, 2, 6, 0.4), (1, 3, 9, 0.3), (2, 1, 7, None), (4, 1, 8, 0.1)], schema)
    assert rows(runs.differing_lists(kept, again), "qid", "places", "differing") == [(1, 3, 2), (2, 1, 0), (3, 1, 1), (4, 1, 1)]
    assert runs.differing_lists(kept.limit(0), again.limit(0)).count() == 0


def test_runs_are_appended_and_never_overwritten(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), required=("k",))
    assert store.runs().count() == 0
    table = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long")
    first, second = (store.append(table(*xs), "dense", "dev", {"k": 10}) for xs in ((1, 2), (3,)))
    other = store.append(table(7), "bm25", "test", {"k": 10, "b": 0.75})
    assert len({first, second, other}) == 3
    assert rows(store.rows(store.runs(), "x long"), "system", "split", "x") == [("bm25", "test", 7), ("dense", "dev", 1), ("dense", "dev", 2), ("dense", "dev", 3)]
    assert rows(store.rows(store.newest(), "x long"), "system", "x") == [("bm25", 7), ("dense", 3)]
    assert rows(store.newest(), "config", "rows") == [('{"b": 0.75, "k": 10}', 1), ('{"k": 10}', 1)]
    for system, config, df in (("a/b", {"k": 1}, table(1)), ("..", {"k": 1}, table(1)), ("a", {}, table(1)), ("a", {"k": 1}, table(1).withColumn("run", F.lit(1)))):
        with pytest.raises(ValueError):
            store.append(df, system, "dev", config)
    assert store.runs().count() == 3


def test_a_run_whose_job_died_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "runs")
    store = RunStore(spark, folder)
    run = store.append(spark.range(3), "a", "dev", {})
    spark.range(9).write.parquet(f"{folder}/rows/system=a/split=dev/run=half")
    assert store.rows(store.runs(), "id long").count() == 3
    with pytest.raises(ValueError, match="not whole"):
        store.rows(spark.createDataFrame([("half",)], "run string"), "id long")
    spark.range(1).write.mode("append").parquet(f"{folder}/rows/system=a/split=dev/run={run}")
    with pytest.raises(ValueError, match="not whole"):
        store.rows(store.runs(), "id long")


def test_question_sets_keep_unresolved_titles_in_the_denominator(spark):
    raws = spark.createDataFrame([("q1", ["Ann Lee", "bob  ray"]), ("q2", ["Twin", "Nobody"]), ("q3", ["Ann Lee", "Ann Lee"])], "qid string, titles array<string>")
    units = spark.createDataFrame([(1, "Ann Lee"), (2, "Bob Ray"), (3, "Twin"), (4, "Twin")], "unit_id long, title string")
    old = spark.createDataFrame([("q2",), ("q2",)], "qid string")
    got = questions.build(raws, units, old)
    assert rows(got, "qid", "position", "unit_id", "how", "cohort") == [
        ("q1", 0, "1", "exact", questions.UNSEEN), ("q1", 1, "2", "normalized", questions.UNSEEN), ("q2", 0, "unresolved:q2:0", "ambiguous", questions.HISTORICAL),
        ("q2", 1, "unresolved:q2:1", "unmatched", questions.HISTORICAL), ("q3", 0, "1", "exact", questions.UNSEEN), ("q3", 1, "1", "exact", questions.UNSEEN),
    ]
    body = questions.body(got, 0).first()
    assert [body[c] for c in ("questions", "historical", "unseen", "affected", "unmatched_gold", "ambiguous_gold", "titles", "exact", "state")] == [3, 1, 2, 1, 1, 1, 4, 1, questions.STOP]
    assert questions.body(got, 1).first()["state"] is None
    for bad_raws, bad_old in ((raws.unionByName(raws), old), (raws.withColumn("titles", F.slice("titles", 1, 1)), old), (raws, spark.createDataFrame([("q9",)], "qid string"))):
        with pytest.raises(ValueError):
            questions.build(bad_raws, units, bad_old)


def test_conformance_names_what_differs(spark):
    source = spark.createDataFrame([("train", 1, True, 2), ("train", 2, True, 2), ("dev", 3, True, 4)], "part string, qid long, answerable boolean, supporting int")
    assert questions.conformance(source, {"train": 2, "dev": 1}, {2: 2, 4: 1}).count() == 0
    odd = source.unionByName(spark.createDataFrame([("extra", 3, None, 9)], source.schema))
    got = questions.conformance(odd, {"train": 3, "dev": 1, "gone": 5}, {2: 2, 4: 1})
    assert rows(got, "check", "found", "expected") == [
        ("not answerable", 1, 0), ("questions with 9 supporting", 1, 0), ("repeated ids", 1, 0), ("rows of extra", 1, 0), ("rows of gone", 0, 5), ("rows of train", 2, 3)
    ]


def test_query_arms(spark):
    rng = np.random.default_rng(5)
    atoms = np.abs(rng.normal(size=(20, 6)))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    values = rng.normal(size=(4, 6))
    asked = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in enumerate(values)], "qid long, v array<double>")
    by_arm = {arm: {(r["qid"], r["node_id"]): r["c"] for r in concepts.query_arm(asked, atoms, arm, 0.1 if arm == "sparse_coding" else None).collect()} for arm in concepts.QUERY_ARMS}
    plain = values @ atoms.T
    assert set(by_arm["projection_full"]) == {(q, k) for q, k in np.argwhere(plain > 0).tolist()}
    for q in range(4):
        best = sorted((k for k in range(20) if plain[q, k] > 0), key=lambda k: (-plain[q, k], k))[:16]
        assert {k for p, k in by_arm["projection_top16"] if p == q} == set(best)
        code = np.array([by_arm["sparse_coding"].get((q, k), 0.0) for k in range(20)])
        slope = atoms @ (values[q] - code @ atoms) - 0.1  # at the optimum 0 where the code is above 0, and not above 0 elsewhere
        assert np.all(np.abs(slope[code > 0]) < 1e-5) and np.all(slope[code == 0] < 1e-5)
    for arm, alpha in (("other", None), ("projection_full", 0.1), ("sparse_coding", None)):
        with pytest.raises(ValueError):
            concepts.query_arm(asked, atoms, arm, alpha)
    with pytest.raises(ValueError):
        concepts.query_arm(asked, atoms[:8], "projection_top16")


def test_a_twin_in_the_context_counts_only_where_it_may(spark):
    units = spark.createDataFrame([(1, "t", "o"), (2, "t", "o"), (3, "t", "other"), (4, None, "o"), (5, None, "o"), (6, "u", "o"), (7, "u", "o")], "unit_id long, title string, opening string")
    gold = spark.createDataFrame([(10, 1), (10, 3), (11, 4), (12, 6), (12, 7), (12, 6)], "qid long, unit_id long")
    filled = spark.createDataFrame([("a", 10, 2), ("a", 10, 3), ("a", 11, 5), ("a", 12, 6), ("b", 10, 1), ("b", 10, 3)], "system string, qid long, unit_id long")
    systems = spark.createDataFrame([("a",), ("b",), ("c",)], "system string")
    got = runs.twin_gold(filled, systems, gold, units)
    names = ("system", "affected", "gold_in_context", "twin_instead", "neither", "supported", "supported_with_twins", "flips")
    assert rows(got, *names) == [("a", 2, 1, 2, 0, 0, 2, 2), ("b", 2, 1, 0, 2, 1, 1, 0), ("c", 2, 0, 0, 3, 0, 0, 0)]


def test_sweep_holds_every_cell(spark):
    rng = np.random.default_rng(9)
    values = np.abs(rng.normal(size=(40, 6)))
    units = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(values)], "unit_id long, v array<double>")
    spaces = {}
    for size in (16, 20):
        atoms = np.abs(rng.normal(size=(size, 6)))
        spaces[size] = atoms / np.linalg.norm(atoms, axis=1, keepdims=True)
    asked = units.where("unit_id % 20 = 0").select(F.col("unit_id").alias("qid"), "v")
    got = {}
    for r in concepts.sweep(units, asked, spaces, 0.1, k=5).collect():
        got.setdefault((r["size"], r["arm"], r["view"], r["qid"]), []).append((r["rank"], r["unit_id"], r["score"]))
    assert len(got) == 2 * 3 * 2 * 2
    for (size, arm, view, q), hits in got.items():
        codes = concepts.encode(values, spaces[size], 0.1)
        shown = codes / np.maximum(np.abs(codes).sum(axis=1, keepdims=True), 1e-12) if view == "rows" else codes
        own = concepts.encode(values[q : q + 1], spaces[size], 0.1)[0] if arm == "sparse_coding" else np.maximum(spaces[size] @ values[q], 0)
        if arm == "projection_top16":
            own = np.where(np.isin(np.arange(size), np.argsort(-own, kind="stable")[:16]), own, 0)
        scores = shown @ own if view == "codes" else None
        if scores is not None:
            want = np.sort(scores)[::-1][:5]
            assert np.allclose([s for _, _, s in sorted(hits)], want, atol=2e-6)
        assert [r for r, _, _ in sorted(hits)] == [1, 2, 3, 4, 5]
