"""Worked examples and identities of the operators."""

import math
from fractions import Fraction

import numpy as np
import pytest

from hoplattice.functions import stats, text
from hoplattice.operators import concepts, corpus, fusion, graph, grids, lexical, metrics, pack, paired, rank, rerank, seeds, summaries, vector, verdicts, walk
from hoplattice.sources import files
from hoplattice.streaming import frequency


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def two_lists(spark):
    a = [("q", "a", 0.9), ("q", "b", 0.5), ("q", "c", 0.1)]
    b = [("q", "b", 20.0), ("q", "d", 10.0), ("q", "a", 0.0)]
    frame = lambda x: spark.createDataFrame(x, "qid string, unit_id string, score double")
    return fusion.components(a=frame(a), b=frame(b))


def test_weighted_fusion_worked_example(two_lists):
    out = fusion.weighted(two_lists, {"a": 0.5, "b": 0.5})
    assert rows(out.orderBy("rank"), "unit_id", "score") == [("b", 0.75), ("a", 0.5), ("d", 0.25), ("c", 0.0)]


def test_rrf_worked_example(two_lists):
    got = dict(rows(fusion.rrf(two_lists), "unit_id", "score"))
    want = {"b": 1 / 62 + 1 / 61, "a": 1 / 61 + 1 / 63, "d": 1 / 62, "c": 1 / 63}
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_a_weight_of_one_keeps_the_order_and_the_other_units(two_lists):
    out = rows(fusion.weighted(two_lists, {"a": 1.0, "b": 0.0}).orderBy("rank"), "unit_id")
    assert out == [("a",), ("b",), ("c",), ("d",)]


def test_constant_list_abstains_and_weights_must_be_convex(spark, two_lists):
    flat = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 3.0)], "qid string, unit_id string, score double")
    assert rows(rank.min_max(flat), "norm") == [(0.0,), (0.0,)]
    with pytest.raises(ValueError):
        fusion.weighted(two_lists, {"a": 0.7, "b": 0.7})


@pytest.mark.parametrize(("ranking", "budget", "want"), [(["a", "big", "b"], 350, ["a", "b"]), (["a", "b", "c"], 350, ["a", "b", "c"]), (["big"], 100, [])])
def test_packing_skips_what_does_not_fit(spark, ranking, budget, want):
    hits = spark.createDataFrame([("q", u, k + 1) for k, u in enumerate(ranking)], "qid string, unit_id string, rank int")
    tokens = spark.createDataFrame([("a", 100), ("big", 900), ("b", 200), ("c", 50)], "unit_id string, n_tokens int")
    out = pack.fill_contexts(hits, tokens, spark.createDataFrame([(budget,)], "budget int"))
    assert [r[0] for r in rows(out.orderBy("place"), "unit_id")] == want


def test_packing_refuses_a_unit_without_a_count(spark):
    hits = spark.createDataFrame([("q", "x", 1)], "qid string, unit_id string, rank int")
    tokens = spark.createDataFrame([("a", 1)], "unit_id string, n_tokens int")
    with pytest.raises(Exception, match="no token count"):
        pack.fill_contexts(hits, tokens, spark.createDataFrame([(10,)], "budget int")).collect()


def test_ndcg_counts_a_sentinel_in_the_ideal(spark):
    questions = spark.createDataFrame([("q",), ("none",)], "qid string")
    hits = spark.createDataFrame([("q", u, k + 1) for k, u in enumerate(["x", "g1", "y", "g2", "z"])], "qid string, unit_id string, rank int")
    qrels = spark.createDataFrame([("q", "g1"), ("q", "g2"), ("q", "sentinel")], "qid string, unit_id string")
    out = {r["qid"]: r for r in metrics.rank_metrics(questions, hits, qrels).collect()}
    want = (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 0.5)
    assert out["q"]["ndcg"] == pytest.approx(want, abs=1e-8)
    assert out["q"]["support_10"] == 0 and out["q"]["recall_5"] == pytest.approx(2 / 3)
    assert out["none"]["ndcg"] == 0 and out["none"]["support_2"] == 0


@pytest.fixture(scope="module")
def toy_graph(spark):
    units = {"p1x": ["alpha", "river", "bridge"], "zz": ["alpha"], "aa": ["alpha"], "mm": ["river"], "rr": ["beta", "river", "bridge"]}
    incidence = spark.createDataFrame([(u, n) for u, ns in units.items() for n in ns], "unit_id string, node_id string")
    return incidence, spark.createDataFrame([("q", "p1x")], "qid string, unit_id string")


def test_node_hop_worked_example(toy_graph):
    incidence, p1 = toy_graph
    both = graph.node_hop(p1, incidence)
    assert rows(both.orderBy("rank"), "unit_id", "positives") == [("rr", 4), ("aa", 4), ("mm", 4), ("zz", 4)]
    entities = incidence.where("node_id in ('alpha', 'beta')")
    hop = graph.node_hop(p1, entities)
    assert rows(hop.orderBy("rank"), "unit_id", "positives") == [("aa", 2), ("zz", 2)]


def test_gated_by_all_seeds_equals_the_hop_and_alpha_zero_keeps_it(spark, toy_graph):
    incidence, p1 = toy_graph
    seeds = graph.seeds_of(p1, incidence, graph.weights(incidence))
    plain = sorted(rows(graph.node_hop(p1, incidence), "qid", "unit_id", "score", "rank"))
    assert sorted(rows(graph.gated_hop(seeds, seeds, incidence, p1), "qid", "unit_id", "score", "rank")) == plain
    sim = graph.node_hop(p1, incidence).select("qid", "unit_id", graph.F.lit(1.0).alias("sim"))
    mixed = graph.relevance_hop(graph.node_hop(p1, incidence), sim, spark.createDataFrame([(0.0,)], "alpha double"))
    assert sorted(rows(mixed, "qid", "unit_id", "score", "rank")) == plain


def test_hop_matches_plain_python_on_ties(spark):
    rng = np.random.default_rng(2)
    held = {u: set(rng.choice(40, rng.integers(0, 5), replace=False).tolist()) for u in range(300)}
    incidence = spark.createDataFrame([(u, n) for u, ns in held.items() for n in ns], "unit_id long, node_id long")
    p1 = spark.createDataFrame([(u, u) for u in (1, 5, 9)], "qid long, unit_id long")
    some = [u for u in held if held[u]]
    df = {n: sum(n in held[u] for u in some) for n in range(40)}
    w = {n: float(np.float32(math.log1p(len(some) / (1 + df[n])))) for n in df}
    want = []
    for q in (1, 5, 9):
        scored = sorted((-round(sum(w[n] for n in held[q] & held[u]), 6), u) for u in some if u != q and held[q] & held[u])[:10]
        want += [(q, u, -s, k + 1) for k, (s, u) in enumerate(scored)]
    got = sorted(rows(graph.node_hop(p1, incidence, k=10), "qid", "unit_id", "score", "rank"))
    assert [(q, u, round(s, 5), k) for q, u, s, k in got] == [(q, u, round(s, 5), k) for q, u, s, k in sorted(want)]


def test_node_ids_are_dense_and_ordered(spark):
    forms = spark.createDataFrame([("e", f) for f in ("beta", "alpha", "", "alpha", "gamma")] + [("c", "beta")], "type string, form string")
    assert sorted(rows(graph.node_ids(forms), "node_id", "type", "form")) == [(0, "c", "beta"), (1, "e", "alpha"), (2, "e", "beta"), (3, "e", "gamma")]


@pytest.fixture(scope="module")
def diffusion(spark):
    matrix = [[2, 0, 0], [1, 1, 0], [0, 3, 0], [0, 1, 2], [0, 0, 1]]
    x = spark.createDataFrame([(f"u{i}", j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if v], "unit_id string, node_id int, w double")
    return x, walk.seed_mass(spark.createDataFrame([("q", "u0", 2.0), ("q", "u4", -1.0)], "qid string, unit_id string, score double"))


def test_seed_mass_clips(diffusion):
    assert rows(diffusion[1], "unit_id", "mass", "clipped") == [("u0", 1.0, 1)]


def test_walk_reaches_and_restart_one_is_the_seed(diffusion):
    x, seeds = diffusion
    one = {r["unit_id"]: r["mass"] for r in walk.walk(seeds, x, 0.5, rounds=1).collect()}
    assert one["u0"] > 0 and one["u1"] > 0 and one.get("u2", 0) == 0
    two = {r["unit_id"]: r["mass"] for r in walk.walk(seeds, x, 0.5, rounds=2).collect()}
    assert two["u2"] > 0 and two["u3"] > 0 and sum(two.values()) == pytest.approx(1)
    still = walk.walk(seeds, x, 1.0)
    assert {r["unit_id"]: r["mass"] for r in still.where("mass > 0").collect()} == {"u0": 1.0}
    assert rows(walk.statistics(still), "rounds", "stop") == [(1, "converged")]


def test_pool_and_reorder(spark):
    lists = {"A": "abc", "B": "bd", "C": "ca", "D": "e"}
    table = spark.createDataFrame([(s, "q", u, k + 1) for s, us in lists.items() for k, u in enumerate(us)], "system string, qid string, unit_id string, rank int")
    pooled = rerank.pool(table)
    assert [r[0] for r in rows(pooled.orderBy("place"), "unit_id")] == ["a", "b", "c", "e", "d"]
    hits = spark.createDataFrame([("q", f"u{k}", k) for k in (1, 2, 3, 4)], "qid string, unit_id string, rank int")
    judged = spark.createDataFrame([("q", "u1", 0.5), ("q", "u2", 2.0), ("q", "u3", 0.5), ("q", "u4", -1.0)], "qid string, unit_id string, judge double")
    assert [r[0] for r in rows(rerank.reorder(hits, judged).orderBy("rank"), "unit_id")] == ["u2", "u1", "u3", "u4"]


def test_statistics_of_published_examples(spark):
    one = lambda *values: [np.array([v]) for v in values]
    assert stats.discordant_p(*one(317, 72))[0] == pytest.approx(8.996e-38, rel=1e-3)
    assert stats.discordant_p(np.array([0, 5, 1, 9]), np.array([0, 5, 0, 1])).tolist() == pytest.approx([1, 1, 1, 22 / 1024])
    assert stats.at_least_p(*one(56, 24))[0] == pytest.approx(0.00022576, rel=1e-4)
    assert stats.at_least_p(np.array([0, 3, 0]), np.array([0, 0, 3])).tolist() == pytest.approx([1, 1 / 8, 1])
    for flips, heads in ((1, 0), (10, 3), (11, 7), (2000, 900), (2000, 1100)):
        want = Fraction(sum(math.comb(flips, k) for k in range(heads + 1)), 1 << flips)
        assert stats.fair_coin_tail(flips, heads) == pytest.approx(float(want), rel=1e-9)
    # a cross-over trial on contact lenses: 44 pairs, one discordant
    assert round(stats.tango_z(*one(0, 1, 44), -0.1)[0], 3) == 1.709
    assert round(stats.tango_limits(*one(0, 1, 44), 1.6448536)[0][0], 3) == -0.096
    low, high = (x[0] for x in stats.tango_limits(*one(96, 60, 1400)))
    assert low < 36 / 1400 < high and stats.tango_z(*one(96, 60, 1400), low)[0] == pytest.approx(stats.Z95, abs=1e-6)
    assert stats.not_worse(96, 60, 1400, 0.05) and not stats.not_worse(60, 96, 1400, 0.01)
    table = spark.createDataFrame([(10, 30, 5, 55, 100)], "both long, only_a long, only_b long, neither long, n long")
    r = paired.compared(table).first()
    assert r["label"] == "supported" and r["low"] < r["difference"] < r["high"]


def test_paired_refuses_a_missing_question(spark):
    a = spark.createDataFrame([("q1", 1), ("q2", 0)], "qid string, full_support int")
    with pytest.raises(Exception, match="one side only"):
        paired.paired_table(a, a.where("qid = 'q1'")).collect()


def test_gate_and_screen(spark):
    t = spark.createDataFrame([(True, True, False, False), (True, False, True, False), (True, False, False, False), (False, False, False, False)], "both_beat_comparator boolean, both_beat_entities boolean, entities_beat_comparator boolean, concepts_beat_comparator boolean")
    assert sorted(rows(paired.gate(t), "outcome", "anomaly")) == [("GO", False), ("NAMES_ONLY", False), ("STOP", False), ("STOP", True)]
    s = spark.createDataFrame([(15, 10, 8, 100), (14, 10, 8, 100)], "w int, t1 int, t2 int, n int")
    assert sorted(rows(paired.screen_verdict(s), "w", "verdict")) == [(14, "stop"), (15, "pass")]


def test_grids_have_the_declared_sizes():
    assert len(grids.simplex(["a", "b"])) == 11 and len(grids.simplex(list("abc"))) == 66 and len(grids.simplex(list("abcd"))) == 286


@pytest.mark.parametrize(("raw", "want"), [("The Beatles", "beatles"), ("AC/DC", "ac dc"), ("(album)", "album"), ("St. Louis", "st. louis"), ("Coca-Cola", "coca cola"), ("Straße", "strasse"), ("Beyoncé", "beyonce"), ("the", "the"), ("...", "")])
def test_node_form(raw, want):
    assert text.node_form(raw) == want


def test_mentions_and_windows(spark):
    assert text.mentions_in("cameron", "james cameron directed it") == [(6, 1, 1)]
    assert text.mentions_in("cameron", "camerons directed it") == []
    assert text.mentions_in("st. louis", "born in st. louis, missouri") == [(8, 2, 3)]
    df = spark.createDataFrame([("one two three x four five", 3)], "t string, k int")
    assert rows(df.select(text.mention_window(graph.F.col("t"), graph.F.col("k"), graph.F.col("k")).alias("w")), "w") == [("one two three four five",)]


def test_paragraphs_skip_blank_lines(spark):
    df = spark.createDataFrame([(1, " a b \n\n  \nc"), (2, None)], "id long, body string")
    assert sorted(rows(text.paragraphs(df, "id", "body"), "id", "position", "text", "start", "end")) == [(1, 0, "a b", 1, 4), (1, 1, "c", 10, 11)]


def test_windows_records_and_answers(spark):
    F = graph.F
    df = spark.createDataFrame([(["T.", "a", "b", "c"], [1, 2, 2, 9])], "s array<string>, n array<int>")
    assert df.select(text.windows_under(F.col("s"), F.col("n"), 5).alias("w")).first()["w"] == ["T. a b", "c"]
    forms = spark.createDataFrame([([" x ", "", "x", "y"],), (["z" * 200],)], "f array<string>")
    got = [r["r"] for r in forms.select(text.span_record(F.col("f")).alias("r")).collect()]
    assert [(r["status"], r["forms"]) for r in got] == [("ok", ["x", "y"]), ("failed", [])]
    answers = spark.createDataFrame([('{"entities": ["a"], "concepts": []}',), ("no",), ('{"entities": ["a"]}',)], "a string")
    assert [r[0]["failure"] for r in answers.select(text.validated_answer(F.col("a")).alias("v")).collect()] == [None, "not json", "missing list"]


def test_resolution_of_gold_and_titles(spark):
    context = spark.createDataFrame([("q", "T1", "u1"), ("q", "T2", "u2")], "qid string, title string, unit_id string")
    facts = spark.createDataFrame([("q", "T1"), ("q", "T2"), ("q", "T1")], "qid string, title string")
    assert sorted(rows(corpus.resolve_gold(facts, context), "unit_id")) == [("u1",), ("u2",)]
    with pytest.raises(Exception, match="no context titled"):
        corpus.resolve_gold(spark.createDataFrame([("q", "X")], "qid string, title string"), context).collect()
    held = spark.createDataFrame([("u1", "A b"), ("u2", "Dup"), ("u3", "Dup"), ("u4", "x  Y")], "unit_id string, title string")
    wanted = spark.createDataFrame([("A b",), ("Dup",), ("X y",), ("none",)], "title string")
    assert dict(rows(corpus.resolve_titles(wanted, held), "title", "how")) == {"A b": "exact", "Dup": "ambiguous", "X y": "normalized", "none": "unmatched"}


def test_reconcile_is_one_to_one(spark):
    units = spark.createDataFrame([("a", "T", "x y"), ("b", "t", "z"), ("c", "N", "n")], "unit_id string, title string, text string")
    official = spark.createDataFrame([(1, "T", "x y"), (2, "T", "z"), (3, "t", " z")], "unit_id int, title string, text string")
    assert sorted(rows(corpus.reconcile(units, official), "unit_id", "official_id", "how")) == [("a", 1, "exact"), ("b", 2, "ambiguous"), ("b", 3, "ambiguous")]


def test_sparse_codes_meet_the_optimum(spark):
    rng = np.random.default_rng(0)
    atoms = rng.normal(size=(6, 8))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    x = rng.normal(size=(20, 8))
    c = concepts.encode(x, atoms, 0.1)
    slope = (c @ atoms - x) @ atoms.T + 0.1
    assert (slope > -1e-4).all() and np.abs(slope[c > 0]).max() < 1e-4
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "unit_id long, v array<double>")
    coded = concepts.code_corpus(table, atoms, 0.1)
    assert coded.count() == (c > 0).sum()
    assert concepts.reconstruction_error(table, coded, atoms) == pytest.approx(((x - c @ atoms) ** 2).sum() / (x**2).sum())


def test_duplicate_atoms_merge_transitively():
    a = np.array([[1.0, 0], [0.95, 0.31], [0.8, 0.6], [0, 1.0]])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert concepts.duplicate_groups(a, 0.9).tolist() == [0, 0, 0, 3]
    assert concepts.merged(a, 0.9).shape == (2, 2)


def test_dense_blocks_match_plain_numpy(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(50, 6)), 1)
    units = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "unit_id long, v array<double>")
    out = vector.dense_topk(units.where("unit_id % 10 = 0").withColumnRenamed("unit_id", "qid"), units, 5)
    want = []
    for q in range(0, 50, 10):
        scored = sorted((-round(float(v[q] @ v[u]), 6), u) for u in range(50) if u != q)[:5]
        want += [(q, u, k + 1) for k, (_, u) in enumerate(scored)]
    assert sorted(rows(out, "qid", "unit_id", "rank")) == sorted(want)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    digest = files.write_once(df, str(tmp_path / "t"), "k")
    assert files.read_verified(spark, str(tmp_path / "t"), "k", digest).count() == 2
    with pytest.raises(ValueError):
        files.read_verified(spark, str(tmp_path / "t"), "k", "other")
    with pytest.raises(Exception):
        files.write_once(df, str(tmp_path / "t"), "k")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    assert "| id | t |" in files.markdown(df)


def test_archive_records_drop_a_repeated_title(spark, tmp_path):
    import bz2
    import io
    import tarfile

    lines = b'{"id": "1", "title": "T", "text": ["T", "s1"]}\n{"id": "2", "title": "U", "text": ["s2"]}\n'
    data = bz2.compress(lines)
    with tarfile.open(tmp_path / "a.tar.bz2", "w:bz2") as archive:
        info = tarfile.TarInfo("d/wiki_00.bz2")
        info.size = len(data)
        archive.addfile(info, io.BytesIO(data))
    fields = files.resolved_fields([{"id": "1", "title": "T", "text": []}], {"id": ["_id", "id"], "title": ["title"], "text": ["text"]})
    out = files.archive_records(files.archive_lines(spark, str(tmp_path / "a.tar.bz2")), fields)
    assert sorted(rows(out, "title", "sentences", "page_id")) == [("T", ["s1"], "1"), ("U", ["s2"], "2")]


def test_stream_counts_pairs_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "unit_id long, node_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("unit_id long, node_id string").parquet(str(tmp_path / "in"))
    started = frequency.to_memory(frequency.running_frequency(stream), "df_now").start()
    started.awaitTermination(60)
    assert sorted(rows(spark.table("df_now"), "node_id", "df")) == [("a", 2), ("b", 1)]


def test_seed_sets(spark):
    located = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 1, "c"), ("q", 2, "d")], "qid string, sentence int, node_id string")
    rel = spark.createDataFrame([("q", 0, 0.9), ("q", 1, 0.5), ("q", 2, 0.5)], "qid string, sentence int, rel double")
    named = spark.createDataFrame([("q", "a")], "qid string, node_id string")
    assert sorted(rows(seeds.from_sentences(located, rel, 1), "node_id")) == [("a",)]
    assert sorted(rows(seeds.from_sentences(located, rel, 1, named), "node_id")) == [("b",), ("c",)]
    assert len(rows(seeds.from_sentences(located, rel, None, named), "node_id")) == 3
    windows = spark.createDataFrame([("q", "a", 0.2), ("q", "a", 0.8), ("q", "b", 0.8), ("q", "c", 0.1)], "qid string, node_id string, sim double")
    w = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "node_id string, w double")
    assert [r[0] for r in rows(seeds.from_windows(windows, w, 2).orderBy("place"), "node_id")] == ["b", "a"]
    offsets = located.withColumn("offset", graph.F.lit(1))
    assert rows(seeds.first_mentions(offsets), "node_id") == [("a",)]
    assert rows(seeds.coverage(located, located), "wanted", "located", "share") == [(4, 4, 1.0)]


def test_verdicts(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 1.0)], "qid long, value double")
    assert rows(verdicts.reproduction(a, a), "verdict", "unmatched") == [("reproduced", 0)]
    assert rows(verdicts.reproduction(a, a.where("qid = 1")), "verdict", "unmatched") == [("differs", 1)]
    r = spark.createDataFrame([("h", 1), ("h", 2)], "corpus string, seed int")
    assert rows(verdicts.comparable(r, "corpus"), "comparable") == [(True,)] and rows(verdicts.comparable(r, "corpus", "seed"), "comparable") == [(False,)]
    t = spark.createDataFrame([(0.5,), (0.9,), (1.2,)], "mean_s double")
    assert sorted(rows(verdicts.latency(t), "verdict")) == [("columnwise",), ("rowwise",), ("stop",)]


def test_concept_diagnostics(spark):
    x = spark.createDataFrame([(1, 0, 1.0), (1, 2, 0.5), (2, 0, 2.0)], "unit_id long, node_id int, w double")
    units = spark.createDataFrame([(k, [1.0, 0.0]) for k in (1, 2, 3)], "unit_id long, v array<double>")
    assert rows(concepts.diagnostics(x, units, 4), "dead_atoms", "orphan_units", "active_max", "units_max") == [(2, 1, 2, 2)]
    assert concepts.null_coherence(units, size=3, draws=1) == (1.0, 0.0)


def test_holders_finds_whole_passages_as_they_stand(spark):
    needles = [(1, "ab"), (2, "abc"), (3, "x" * 24 + "yes"), (4, "x" * 24 + "no"), (5, ""), (6, None), (7, "é.*"), (8, "ab")]
    docs = [(10, "xx abc ab"), (11, "x" * 30 + "yes"), (12, None), (13, ""), (14, "é.*" + "x" * 24 + "no"), (10, "abd")]
    got = sorted((r["needle_id"], r["doc_id"]) for r in corpus.holders(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted((i, d) for i, n in needles for d, t in docs if n and t and n in t)


def test_walk_in_blocks_equals_dense_arithmetic(spark, monkeypatch):
    monkeypatch.setattr(walk, "BLOCK", 3)
    monkeypatch.setattr(walk, "EDGES", 2)
    rng = np.random.default_rng(2)
    w = rng.integers(0, 4, (7, 9)).astype(float)
    w[w.sum(1) == 0, 0], w[0, w.sum(0) == 0] = 1, 1
    x = spark.createDataFrame([(u, n, float(w[u, n])) for u in range(7) for n in range(9) if w[u, n]], "unit_id long, node_id long, w double")
    seeds = spark.createDataFrame([(q, int(u), 0.5) for q in range(4) for u in (q, q + 2)], "qid long, unit_id long, mass double")
    got = {(r["qid"], r["unit_id"]): r["mass"] for r in walk.walk(seeds, x, 0.5, "symmetric").collect()}
    rare = np.float32(np.log1p(7 / (1 + (w > 0).sum(0)))).astype(float)
    p = w / np.sqrt(w.sum(1)[:, None] * w.sum(0)[None])
    for q in range(4):
        start = np.zeros(7)
        start[[q, q + 2]] = 0.5
        m = start
        for _ in range(5):
            s = p @ ((p.T @ m) * rare)
            new = 0.5 * s / s.sum() + 0.5 * start
            moved, m = np.abs(new - m).sum(), new
            if moved < 1e-3:
                break
        assert [got.get((q, u), 0.0) for u in range(7)] == pytest.approx(m.tolist(), abs=1e-12)


def test_summaries_refuse_what_is_missing(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "unit_id long, v array<double>")
    assert summaries.checked_width(vectors.where("unit_id = 1"), 2).count() == 1
    for bad in (vectors, spark.createDataFrame([(1, None)], "unit_id long, v array<double>")):
        with pytest.raises(Exception, match="components"):
            summaries.checked_width(bad, 2).collect()
    cohorts = spark.createDataFrame([(1, "a"), (2, "a")], "qid long, cohort string")
    outcomes = spark.createDataFrame([(1, 1, 0.5)], "qid long, success int, recall double")
    with pytest.raises(Exception, match="no outcome"):
        summaries.by_cohort(outcomes, cohorts).collect()
    assert summaries.by_cohort(outcomes, cohorts.where("qid = 1")).first()["supported"] == 1


def test_samples_share_no_row(spark):
    rows_ = spark.range(100).withColumnRenamed("id", "doc_id")
    got = summaries.disjoint_samples(rows_, "doc_id", {"a": 5, "b": 7}).collect()
    assert len({r["doc_id"] for r in got}) == 12 and sum(r["sample"] == "a" for r in got) == 5
    assert summaries.disjoint_samples(rows_.limit(0), "doc_id", {"a": 5}).count() == 0


def test_bounded_occurrence_of_a_column(spark):
    t = spark.createDataFrame([("st. louis", "in st. louis, mo"), ("cameron", "camerons"), ("a+b", "x a+b y"), (None, "a"), ("é", "été é")], "form string, text string")
    assert [r[0] for r in t.select(text.occurs(t["form"], t["text"])).collect()] == [True, False, True, None, True]


def test_bm25_in_blocks_equals_one_block(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 13}x" for j in range(1, 9))) for k in range(40)] + [(99, None), (98, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q}x w{q + 1}x w{q}x the") for q in range(7)] + [(8, None)], "qid long, query string")
    whole = sorted(map(tuple, lexical.bm25(asked, docs, 5).collect()))
    monkeypatch.setattr(lexical, "BLOCK", 2)
    monkeypatch.setattr(lexical, "_UNITS", 3)
    assert sorted(map(tuple, lexical.bm25(asked, docs, 5).collect())) == whole and whole
