"""The prefix trie against all beginnings listed one by one, over many shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from hoplattice.llm import prefix_trie


def brute(rows, rebuild=True):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    seqs = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        seqs[c] = tuple(plain.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    children, leaves, saved = defaultdict(list), {}, {}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(seqs[c]) == len(p)).encode()).hexdigest()
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), len(children[p]), leaves[p], saved[p], digest(p)) for p in members)


def nodes(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.collect())


def table(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)


def random_rows(seed, convs):
    """Few texts, so that beginnings are shared at every depth; hot openings, copies, nulls and gaps."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(6 * convs), convs):
        hot = rng.random() < 0.3
        for turn in range(2 if hot else rng.randint(1, 12)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], "same opening" if hot else rng.choice(["", "a", "é", "bb", None])))
    return rows + [(None, 0, "user", "lost"), (rows[0][0], None, None, "first of all")]


@pytest.mark.parametrize("shard_turns", [7, 60, 250_000])
def test_trie_equals_brute_force_whatever_the_shards(spark, shard_turns):
    rows = random_rows(shard_turns, 220)
    turns = prefix_trie.turn_ids(table(spark, rows))
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(turns), shard_turns)) == brute(rows)
    assert nodes(prefix_trie.trie(prefix_trie.sequences(turns), shard_turns)) == brute(rows, rebuild=False)


def test_a_hot_opening_goes_through_many_shards(spark):
    rows = [(c, t, "user", "hot" if t < 3 else f"{c}") for c in range(120) for t in range(5)] + [(500 + c, t, "user", "hot") for c in range(40) for t in range(3)]
    made = prefix_trie.trie(prefix_trie.sequences(prefix_trie.turn_ids(table(spark, rows))), shard_turns=20)
    assert nodes(made) == brute(rows, rebuild=False)


def test_copies_and_blocks_of_ids(spark):
    rows = [(c, 0, "user", "copy") for c in [*range(1, 30), 5_000, 5_001, 9_999_999, -7, -5_000]]
    got = nodes(prefix_trie.trie(prefix_trie.sequences(prefix_trie.turn_ids(table(spark, rows)))))
    assert got == brute(rows, rebuild=False) and got[0][3] == 34


def test_odd_cases(spark):
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(table(spark, []))))) == []
    # h of 0 is 7: conversation 1 opens with all of conversation 0's turns, 7 is turnless unless it has more than h turns
    rows = [(0, 0, "user", "x"), (0, 0, "user", "x"), (1, 0, None, None), (7, 3, "user", "y" * 70_000), (12, 1, "u", "1:a"), (13, 1, "u1", ":a")]
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(table(spark, rows))))) == brute(rows)
    extra = table(spark, rows).selectExpr("*", "1 AS seq", "'x' AS token", "conv_id AS family")
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_ids(extra)))) == brute(rows)


def test_a_very_long_conversation(spark):
    rows = [(1, t, "user", f"{t}") for t in range(3_000)] + [(2, t, "user", f"{t}") for t in range(2_000)] + [(3, t, "user", f"{t}") for t in range(2_500)]
    assert nodes(prefix_trie.trie(prefix_trie.sequences(prefix_trie.turn_ids(table(spark, rows))), shard_turns=1_000)) == brute(rows, rebuild=False)


def test_medians_balance_the_tree():
    assert sorted(prefix_trie.medians(37)) == list(range(37)) and next(prefix_trie.medians(37)) == 18
    tree = prefix_trie.TernaryTree()
    for k in prefix_trie.medians(1_023):
        tree.insert([k])
    depth, level = 0, [tree.equal[0]]
    while level:
        depth, level = depth + 1, [c for n in level for c in (tree.low[n], tree.high[n]) if c]
    assert depth == 10 and [tree.key[n] for n in tree.in_order()] == list(range(1_023))
