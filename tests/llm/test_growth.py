"""What must hold at sizes beyond any fixture: recall of the forest, bytes that reach the driver."""

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hoplattice.llm import bpe, embedding_dedup, lm, simhash_dedup, votes

RNG = np.random.default_rng(12)


def clustered(n, dimension=64):
    centres = RNG.normal(size=(40, dimension))
    vectors = centres[RNG.integers(0, 40, n)] + RNG.normal(0, 0.8, (n, dimension))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.mark.parametrize(("rows", "cosine"), [(10_000, 0.95), (10_000, 0.97), (10_000_000, 0.95), (1_000_000_000, 0.95)])
def test_op7_recall_at_the_threshold_holds_at_every_size(rows, cosine):
    """Pairs of vectors that neither the trees nor their number were fitted on."""
    vectors = clustered(8_000)
    trees = embedding_dedup.forest(vectors[:6_000], rows, 0.95)
    a = vectors[6_000:]
    b = embedding_dedup.pairs_at(a, cosine, RNG)
    np.testing.assert_allclose((a * b).sum(axis=1), cosine, atol=1e-12)
    met = np.zeros(len(a), bool)
    for tree in trees:
        met |= embedding_dedup.meeting(tree, a, b)
    assert met.mean() >= 0.95


def test_op7_trees_grow_with_the_table():
    vectors = clustered(6_000)
    counts = [len(embedding_dedup.forest(vectors, n, 0.95)) for n in (100, 10_000, 1_000_000)]
    assert counts[0] == 1 and counts == sorted(counts) and counts[-1] > counts[1]


def test_op7_a_dimension_without_a_sample_is_split_too():
    vectors = clustered(3_000, 24)
    trees = embedding_dedup.forest(np.zeros((0, 24)), 3_000, 0.95, leaf_target=100)
    met = np.zeros(3_000, bool)
    near = embedding_dedup.pairs_at(vectors, 0.95, RNG)
    for tree in trees:
        assert max(len(rows) for _, rows in embedding_dedup.leaves_of(tree, vectors)) < 1_500
        met |= embedding_dedup.meeting(tree, vectors, near)
    assert met.mean() >= 0.95


def test_op7_dimensions_apart_equal_brute_force(spark):
    rows, vectors = [], {}
    for k, d in enumerate([3] * 40 + [5] * 60 + [8] * 30):
        v = RNG.normal(size=d) if k % 3 or not rows or len(rows[-1][1]) != d else np.array(rows[-1][1]) + RNG.normal(0, 0.02, d)
        rows.append((k, [float(c) for c in v]))
        vectors[k] = v / np.linalg.norm(v)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0, sample_rows=20, leaf_target=16).collect()}
    want = {k: sum(len(v) == len(w) and j != k and float(v @ w) >= 0.95 for j, w in vectors.items()) for k, v in vectors.items()}
    assert sum(want.values()) > 20 and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


@pytest.mark.parametrize("replicas", [1, 2, 31, 70])
def test_op8_models_are_averaged_to_one_row(spark, replicas):
    flats = RNG.normal(size=(replicas, 5)).astype("<f4")
    tokens = RNG.integers(1, 100, replicas)
    rows = [(k, int(tokens[k]), bytearray(flats[k].tobytes())) for k in range(replicas) if k != 3]
    models = spark.createDataFrame(rows, "replica int, tokens long, flat binary").repartition(3)
    (got,) = lm.averaged(models, replicas, fan=4).collect()
    here = [k for k in range(replicas) if k != 3]
    assert got["tokens"] == tokens[here].sum()
    np.testing.assert_allclose(np.frombuffer(got["flat"], "<f4"), np.average(flats[here], axis=0, weights=tokens[here]), rtol=1e-5, atol=1e-6)


def test_op8_long_words_stay_in_spark_and_scores_are_right(spark):
    """A word of 5,000 bytes in every text is counted, but neither collected nor broadcast."""
    long_word = "y" * 5_000
    rows = [(k, f"{long_word} a b" if k % 2 else f"a {long_word}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm.word_counts(docs.selectExpr("text"))
    stats = lm.statistics(counts)
    assert long_word.encode() not in stats.hot and b"a" in stats.hot and stats.distinct == 4
    got = {r["doc_id"]: r for r in lm.score(docs.withColumn("score", docs.doc_id)).collect()}
    trained = [t.split() for k, t in rows if not got[k]["held_out"]]
    n = sum(len(t) + 1 for t in trained)
    c = {w: sum(t.count(w) for t in trained) for w in ("a", "b", long_word)}
    for k, t in rows:
        base = sum(np.log10((c[w] + 1) / (n + 5)) for w in t.split()) + np.log10((len(trained) + 1) / (n + 5))
        assert got[k]["n_known"] == len(t.split()) + 1 and abs(got[k]["base_score"] - base) < 1e-9


@pytest.mark.parametrize("rows", [10_000, 1_000_000, 1_000_000_000])
def test_pipeline_recall_at_just_the_similarity_holds_at_every_size(rows):
    """Pairs of fingerprints made by the repository's own votes, of sets that no table was solved on."""
    tables, radius = simhash_dedup.sampled_tables(256, 0.8, rows)
    for common, left, right in ((160, 20, 20), (160, 0, 40), (80, 10, 10), (16, 2, 2), (16, 0, 4), (8, 1, 1), (8, 0, 2)):
        n, met = 300, 0
        sets = RNG.integers(0, 1 << 63, (n, common + left + right), dtype=np.uint64)
        bits = []
        for own in (np.r_[0 : common + left], np.r_[0:common, common + left : common + left + right]):
            hashes = sets[:, own]
            group = np.repeat(np.arange(n), len(own))
            words = [votes.majority(votes.ones(group, simhash_dedup._mixed(hashes.ravel(), k), n), np.full(n, len(own))) for k in range(4)]
            bits.append(np.unpackbits(np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(n, -1), axis=1))
        differ = bits[0] != bits[1]
        agree = np.zeros(n, bool)
        for places in tables:
            agree |= ~differ[:, places].any(axis=1)
        met = (agree & (differ.sum(axis=1) <= radius)).mean()
        assert met >= 0.92, (common, left, right, met)  # 0.955 less what 300 pairs may be off


def test_pipeline_small_sets_are_met_exactly(spark):
    """All texts of up to 13 words that differ by a word at either end: sets of up to 9 shingles."""
    texts = [" ".join(f"w{j}" for j in range(a, a + n)) for a in range(3) for n in range(1, 14)] + ["x " * 40, "x " * 60]
    shingles = [{" ".join(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for t in texts]
    link = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(shingles):
            root[i] = min(root[j] for j, b in enumerate(shingles) if link(a, b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash_dedup.one_of_each_group(docs).collect()) == sorted(set(root))


def test_small_sets_bound():
    assert simhash_dedup.small_sets(0.8) == 9 and simhash_dedup.small_sets(0.5) == 3
    for similarity in (0.8, 0.5, 0.75, 0.9):
        n = simhash_dedup.small_sets(similarity)
        assert all(u - 2 < similarity * u - 1e-9 for u in range(2, n + 1)) and n + 1 - 2 >= similarity * (n + 1) - 1e-9


def test_op2_a_long_word_in_every_text_is_spread(spark):
    """One word of 200 characters in 400 texts, half of them copies: no task holds most of its places."""
    word = "q" * 200
    rows = [(k, f"{word} common words" if k % 2 else f"common {word} number{k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    assert all(got[k] == library.encode(t, add_special_tokens=False).ids for k, t in rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in bpe.encode(docs).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 200
