"""The prefix trie of conversations: every distinct beginning is a node with its members, leaves and savings.

Turns become ids of 20 bytes: 16 of the SHA-256 of role and text, and the UTF-8 length of the
text, so no text travels beyond its own row. A conversation is the string of its turns' ids, whose order as bytes is
the order of turn sequences with every beginning right before what continues it.

1. One shuffle brings together the conversations that share an opening (``rebuilt``), or just each one's turns.
2. Copies are reduced: per distinct sequence and block of ``ID_BLOCK`` conversation ids one row, with their count
   and their sorted ids as text, made on both sides of the shuffle.
3. Distinct sequences are dealt into range shards of some ``SHARD_TURNS`` turns. A hot first turn is spread over as many
   shards as it fills; the digest of a sequence's ids streams over its blocks in order.
4. A shard encodes its ids as small integers by a dictionary of its own, and inserts its sequences, medians first, into a ternary
   search tree. An iterative traversal gives the nodes in order; members, least member,
   children, leaves and savings are added up from the last node to the first.
5. Nodes on a shard's first and last path may go on in its neighbours. They are written as parts, with places in the
   shard and not with sequences. What two neighbouring shards share is a length alone (``_chains``); a part that continues an earlier shard's
   node takes its key, gives back what both counted, and parts are added up by key.

Defined cases: rows with a null conversation id are dropped; a null role or text is empty; a null turn comes first, and turns of
one number are in the order of their ids; repeated rows are turns of their own; a conversation without turns belongs to the
root alone; no conversations give no rows; other columns are not read. A conversation's ids must fit one row (20 bytes a turn, 2 GB).
SHA-256 can't be cut into parts, so one sequence's member ids are digested by one task, as a stream of
blocks in bounded memory.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.llm.common import map_arrow, shuffle_partitions, stored

#: Bytes of a turn's id: of the digest, and of the text's length behind it.
DIGEST, LENGTH = 16, 4
ID = DIGEST + LENGTH
#: Conversation ids whose members of one sequence are one row; a power of two.
ID_BLOCK = 4_096
#: Turns of distinct sequences in a shard, about.
SHARD_TURNS = 250_000
_ROWS = 20_000
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, token)``: each turn's id. The role's length keeps role and text apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0"))
    token = F.concat(F.substring(digest, 1, DIGEST), size)
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), token.alias("token"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """``(family, conv_id, tokens)`` of sorted rows, one conversation after the other."""
    key, tokens = None, []
    for batch in batches:
        for family, conv, token in zip(*(batch.column(c).to_pylist() for c in ("family", "conv_id", "token")), strict=True):
            if (family, conv) != key:
                if key is not None:
                    yield *key, tokens
                key, tokens = (family, conv), []
            tokens.append(token)
    if key is not None:
        yield *key, tokens


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, seq)``: each conversation's turn ids in order, joined."""
    return _sequences(turns.withColumn("family", F.col("conv_id")), lambda family, conv: 0)


def rebuilt(turns: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """``(conv_id, seq)`` of conversations that open with another one's turns.

    The first h turns are those of the conversation whose id is c - c % ``family`` (the
    remainder has the sign of c; fewer, or none, where that has fewer or is absent), then come c's own
    turns after its first h; h is the CRC-32 of c in decimal, modulo ``modulus``.
    """
    return _sequences(turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % family), lambda _, conv: zlib.crc32(str(conv).encode()) % modulus, modulus)


def _sequences(turns: DataFrame, opening, longest: int = 1) -> DataFrame:
    dealt = turns.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "token")

    def rows(batches: Iterator[pa.RecordBatch]):
        base, start, out, size = None, [], {"conv_id": [], "seq": []}, 0
        for family, conv, tokens in _grouped(batches):
            if family != base:
                base, start = family, tokens[:longest] if conv == family else []
            h = opening(family, conv)
            seq = b"".join(start[:h] + tokens[h:])
            out["conv_id"].append(conv)
            out["seq"].append(seq)
            size += len(seq) + 64
            if size > 4 << 20:
                yield out
                out, size = {"conv_id": [], "seq": []}, 0
        yield out

    return map_arrow(dealt, "conv_id long, seq binary", rows)


class TernaryTree:
    """A ternary search tree over sequences of whole numbers; node 0 is the empty beginning."""

    def __init__(self) -> None:
        self.key, self.low, self.high, self.equal, self.parent = (array("q", [0]) for _ in range(5))

    def _new(self, key: int, parent: int) -> int:
        for column, value in ((self.key, key), (self.low, 0), (self.high, 0), (self.equal, 0), (self.parent, parent)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, codes) -> int:
        """The node of the whole sequence; nodes of its beginnings are made where they are missing."""
        key, low, high, equal = self.key, self.low, self.high, self.equal
        at = 0
        for code in codes:
            child = equal[at]
            if not child:
                child = equal[at] = self._new(code, at)
            while key[child] != code:
                side = low if code < key[child] else high
                if not side[child]:
                    side[child] = self._new(code, at)
                child = side[child]
            at = child
        return at

    def in_order(self) -> Iterator[int]:
        """All nodes but 0, each after its beginnings and in the order of sequences, without recursion."""
        waiting = [(self.equal[0], False)]
        while waiting:
            node, passed = waiting.pop()
            while node and not passed:  # down the smaller siblings
                waiting.append((node, True))
                node = self.low[node]
            if passed:
                yield node
                waiting.append((self.high[node], False))
                waiting.append((self.equal[node], False))

    def path(self, node: int) -> list[int]:
        """The node's beginnings from 0 to itself."""
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out[::-1]


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of the halves: sorted input gives balanced trees."""
    waiting = deque([(0, n)])
    while waiting:
        low, high = waiting.popleft()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += (low, middle), (middle + 1, high)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, str]]:
    """``(seq, members, least member, digest of the members)`` from rows sorted by sequence and block."""
    current, members, least, digest = None, 0, 0, None
    for batch in batches:
        for seq, n, m, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "least", "ids")), strict=True):
            if seq != current:
                if digest:
                    yield current, members, least, digest.hexdigest()
                current, members, least, digest = seq, 0, m, hashlib.sha256()
            digest.update((("," if members else "") + ids).encode())
            members, least = members + n, min(least, m)
    if digest:
        yield current, members, least, digest.hexdigest()


_PART = "seq_first binary, seq_last binary, side int, inside int, up_side int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int"


def _shard(sorted_rows: list[tuple[bytes, int, int, str]], shard: int) -> Iterator[dict]:
    """Nodes of one range shard. ``side`` is null for a final node, 0 for one on the first path, 1 for one on the last only."""
    flat = np.frombuffer(b"".join(r[0] for r in sorted_rows), f"S{ID}")
    known, codes = np.unique(flat, return_inverse=True)  # the shard's dictionary, in the order of the ids
    sizes = np.frombuffer(known.tobytes(), np.uint8).reshape(-1, ID)[:, DIGEST:].astype(np.int64) @ (256 ** np.arange(LENGTH - 1, -1, -1, dtype=np.int64))
    ends = np.cumsum([0] + [len(r[0]) // ID for r in sorted_rows])
    tree = TernaryTree()
    last = [0] * len(sorted_rows)
    for k in medians(len(sorted_rows)):
        last[k] = tree.insert(codes[ends[k] : ends[k + 1]].tolist())
    size = len(tree.key)
    order = [0, *tree.in_order()]
    members, least = [0] * size, [None] * size
    children, leaves, saved, depth = [0] * size, [0] * size, [0] * size, [0] * size
    own: list[str | None] = [None] * size
    for node, (_, n, m, digest) in zip(last, sorted_rows, strict=True):
        members[node], least[node], own[node] = n, m, digest
    for node in order[1:]:
        depth[node] = depth[tree.parent[node]] + 1
    for node in reversed(order):
        if not children[node]:
            leaves[node] = 1
        if node:
            saved[node] += (members[node] - 1) * int(sizes[tree.key[node]])
            up = tree.parent[node]
            members[up] += members[node]
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            children[up] += 1
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
    first, final = tree.path(last[0]), tree.path(last[-1])
    inside = next((d for d, (a, b) in enumerate(zip(first, final, strict=False)) if a != b), min(len(first), len(final))) - 1
    side = dict.fromkeys(final, 1) | dict.fromkeys(first, 0)
    for k in range(0, size, _ROWS):
        part = order[k : k + _ROWS]
        up = [tree.parent[n] for n in part]
        yield {
            "seq_first": [sorted_rows[0][0] if n == 0 else None for n in part],
            "seq_last": [sorted_rows[-1][0] if n == 0 else None for n in part],
            "side": [side.get(n) for n in part],
            "inside": [inside] * len(part),
            "up_side": [side.get(u) if n else None for n, u in zip(part, up, strict=True)],
            "conv_id": [least[n] for n in part],
            "depth": [depth[n] for n in part],
            "parent_conv_id": [least[u] if n else None for n, u in zip(part, up, strict=True)],
            "n_convs": [members[n] for n in part],
            "n_children": [children[n] for n in part],
            "n_leaves": [leaves[n] for n in part],
            "saved_tokens": [saved[n] for n in part],
            "ends_sha256": [own[n] for n in part],
            "shard": [shard] * len(part),
        }


def _common(a: bytes, b: bytes) -> int:
    """Ids that two sequences begin with alike."""
    n = min(len(a), len(b)) // ID
    x, y = (np.frombuffer(s[: n * ID], np.uint8).reshape(n, ID) for s in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """For each shard, in order: whose nodes its first path continues.

    ``keys[d]`` is the key of the continued node of depth d, 2 * shard + side of its
    first part; ``twice[d]`` the bytes of continued turns from depth d on, which
    earlier parts have counted once too often; ``open`` tells that the shard's last sequence
    is continued by the next shard's first, so that it is no leaf (that goes out with the next row).
    """
    before, keys, waiting = None, [], None
    for batch in batches:
        for shard, inside, first, last in zip(*(batch.column(c).to_pylist() for c in ("shard", "inside", "seq_first", "seq_last")), strict=True):
            shared = -1 if before is None else _common(before, first)
            if waiting is not None:
                waiting["open"] = [shared == len(before) // ID]
                yield waiting
            keys = keys[: shared + 1]
            passed = list(accumulate((int.from_bytes(first[k * ID - LENGTH : k * ID], "big") for k in range(1, shared + 1)), initial=0))
            twice = [passed[-1] - passed[max(d - 1, 0)] for d in range(shared + 1)]
            waiting = {"shard": [shard], "keys": [list(keys)], "twice": [twice], "open": [False]}
            carried = keys[: inside + 1]
            keys = carried + [2 * shard] * (inside + 1 - len(carried)) + [2 * shard + 1] * (len(last) // ID - inside)
            before = last
    if waiting is not None:
        yield waiting


def trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct beginning of the sequences in ``seqs`` (``conv_id``, ``seq``).

    ``conv_id`` least member, ``depth``, ``parent_conv_id``, ``n_convs`` members,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree, ``ends_sha256`` of the members that end there.
    """
    spark = seqs.sparkSession
    block = F.shiftright("conv_id", ID_BLOCK.bit_length() - 1)
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",")
    copies = stored(seqs.groupBy("seq", block.alias("block")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")), "trie-copies")
    turns = copies.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-turns // (ID * shard_turns)))
    ranged = copies.repartitionByRange(shards, "seq").sortWithinPartitions("seq", "block").select("seq", "n", "least", "ids")

    def nodes(batches: Iterator[pa.RecordBatch]):
        if rows := list(_distinct(batches)):
            yield from _shard(rows, TaskContext.get().partitionId())

    made = stored(map_arrow(ranged, _PART, nodes), "trie-nodes")
    return _merged(made)


_VALUES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _merged(made: DataFrame) -> DataFrame:
    """Final nodes as they are, parts of boundary nodes added up by key, and parents of either."""
    ends = made.where("depth = 0").select("shard", "inside", "seq_first", "seq_last")  # one row a shard
    chains = stored(map_arrow(ends.repartition(1).sortWithinPartitions("shard"), "shard int, keys array<long>, twice array<long>, open boolean", _chains), "trie-chains")

    def key(side: str, depth: F.Column) -> F.Column:
        continued = (F.col(side) == 0) & (depth < F.size("keys"))
        return F.when(continued, F.get("keys", depth.cast("int"))).otherwise(F.col("shard") * F.lit(2).cast("long") + F.col(side))

    d = F.col("depth")
    parts = made.where("side is not null").drop("seq_first", "seq_last").join(chains, "shard")
    continued = (F.col("side") == 0) & (d < F.size("keys"))
    on_last = (F.col("side") == 1) | (d <= F.col("inside"))
    parts = parts.select(
        "shard", "side", "depth", "conv_id", "n_convs", "ends_sha256",
        key("side", d).alias("key"),
        key("up_side", d - 1).alias("up_key"),
        (F.col("n_children") - ((F.col("side") == 0) & (d + 1 < F.size("keys"))).cast("long")).alias("n_children"),
        (F.col("n_leaves") - (F.col("open") & on_last).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + F.when(continued, F.get("twice", d.cast("int"))).otherwise(F.lit(0))).alias("saved_tokens"),
    )
    parts = stored(parts, "trie-parts")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = stored(parts.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.min("up_key").alias("up_key"), *sums, F.max("ends_sha256").alias("ends_sha256")), "trie-boundary")
    parents = whole.select(F.col("key").alias("up_key"), (d + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    boundary = whole.join(parents, ["up_key", "depth"], "left")
    # a final node below a boundary node finds its parent by its place in its own shard, so no key is hot
    places = parts.join(whole.select("key", "depth", F.col("conv_id").alias("of")), ["key", "depth"]).select("shard", F.col("side").alias("up_side"), (d + 1).alias("depth"), "of")
    final = made.where("side is null")
    below = final.where("up_side is not null").drop("parent_conv_id").join(places.withColumnRenamed("of", "parent_conv_id"), ["shard", "up_side", "depth"])
    out = final.where("up_side is null").select(*_VALUES).unionByName(below.select(*_VALUES)).unionByName(boundary.select(*_VALUES))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
