"""SimHash near-dedup: fingerprints of word shingles, linked through sharded BK-trees.

Fingerprints are reduced to the distinct ones and dealt into shards, each of which
holds those that agree on some bits. A BK-tree is built for each shard where its
rows are: children are keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius of its own distance. A shard beyond
``shard_rows`` is cut into chunks, and each pair of chunks is searched by itself,
so no task holds a whole hot shard. From each tree come links to a local root,
never all pairs of a group.

Two ways to choose the shards' bits. For a small radius (``block_tables``): within
``radius`` differing bits, two fingerprints agree on ``k`` at least of ``radius + k``
blocks, so the choices of ``k`` blocks find every link. For a similarity of shingle sets
(``sampled_tables``): random bits, as many tables as find a pair at just that
similarity with the stated recall, over the spread of their distances; the bits of a table grow with the logarithm of
the number of fingerprints, so shards stay small at every size. Sets of a few shingles, whose
distances spread too far, are met exactly: each against all that have one shingle more.

For a similarity, fingerprints only choose candidates: a pair links if the exact
Jaccard similarity of its distinct shingles reaches it. All pairs of a group of near
copies are too many to write, so candidates come in two rounds: the pairs of a
spanning forest of each shard, nearest first; then, of each shard, the rows that the
links found so far leave apart from a candidate travel with their shingle sets, and
their pairs are compared where they meet. No candidate that could join two groups
stays unchecked, and what is written grows with the nodes.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; in ``near_duplicates`` rows with a null id take no part in groups and have a
null component; repeated rows are in one group, rows with one id and different texts
each in their own text's; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoplattice.llm import votes
from hoplattice.llm.common import chunk_pairs, map_arrow, shuffle_partitions, stored
from hoplattice.llm.components import components

#: Share of the pairs at just the similarity that become candidates.
RECALL = 0.955
_ROWS = 64
_EPSILON = 1e-9  # similarities are quotients of whole numbers


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``words`` words, joined by single spaces; of the whole sequence if shorter."""
    found = text.encode().lower().split()
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, seed)]
    length = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    return [digest(joined[a:b], seed) for a, b in zip(starts[: -words + 1 or None].tolist(), ends[words - 1 :].tolist(), strict=True)]


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits of each hash; the hash itself for ``k`` = 0."""
    if k == 0:
        return hashes
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id, text_key, text)``: rows of one id are told apart by a hash of their text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, break_ties: bool = False, id_column: str = "doc_id", text_column: str = "text", distinct: bool = False) -> DataFrame:
    """``(doc_id, fp)``, ``fp`` as ``bits / 8`` bytes, highest first: a bit is 1 if set in over half the shingles' hashes.

    With ``break_ties`` the smallest hash counts half more, so that texts of few
    shingles don't all lean to zero. With ``distinct`` each shingle counts once,
    ``set_key`` and ``size`` tell the set of shingles and their number, and
    ``text_key`` the text.
    """
    source = _keyed(docs, id_column, text_column)
    source = source if distinct else source.drop("text_key")

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), _ROWS):
                hashes = [shingle_set(t, words) if distinct else shingle_hashes(t, words) for t in texts[k : k + _ROWS]]
                sets = {}
                if distinct:
                    sets = {"text_key": batch.column("text_key").slice(k, _ROWS), "set_key": [xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], "size": [len(h) for h in hashes]}
                count = np.array([len(h) for h in hashes], np.float64)
                group = np.repeat(np.arange(len(hashes)), count.astype(np.int64))
                flat = np.concatenate([np.array(h, np.uint64) for h in hashes])
                weight = None
                if break_ties:
                    some = np.flatnonzero(count)
                    flat = np.concatenate([flat, np.array([min(hashes[j]) for j in some], np.uint64)])
                    weight = np.concatenate([np.ones(len(group)), np.full(len(some), 0.5)])
                    group = np.concatenate([group, some])
                    count = count + 0.5 * (count > 0)
                words64 = [votes.majority(votes.ones(group, _mixed(flat, j), len(hashes), weight), count) for j in range(bits // 64)]
                packed = np.stack(words64, axis=1).astype(">u8")
                yield {"doc_id": batch.column("doc_id").slice(k, _ROWS), "fp": [r.tobytes() for r in packed]} | sets

    return map_arrow(source, "doc_id long, fp binary" + (", text_key long, set_key binary, size long" if distinct else ""), rows)


def block_tables(bits: int, radius: int, rows: int, tree_rows: int = 512) -> list[np.ndarray]:
    """Bit positions of each table: every choice of ``agree`` out of ``radius + agree`` blocks.

    Within the radius two fingerprints agree on ``agree`` blocks at least, so every
    number of blocks finds every link. Single blocks give few tables and large
    trees; more blocks are taken only where trees of ``rows`` fingerprints would hold
    more than ``tree_rows`` on average.
    """
    agree = 1
    while agree < 4 and rows >> (bits * agree // (radius + agree)) > tree_rows:
        agree += 1
    blocks = np.array_split(np.arange(bits), radius + agree)
    return [np.concatenate(chosen) for chosen in combinations(blocks, agree)]


def simulated_distances(common: int, left: int, right: int, bits: int, pairs: int = 2_000, seed: int = 23) -> np.ndarray:
    """Differing bits of pairs of random shingle sets that share ``common`` shingles and have ``left`` and ``right`` of their own."""
    rng = np.random.default_rng(seed)
    own = [np.arange(common + left), np.append(np.arange(common), np.arange(common + left, common + left + right))]
    out = []
    for _ in range(0, pairs, 100):
        hashed = rng.integers(0, 2, (100, common + left + right, bits), dtype=np.uint8)
        voted = [2 * hashed[:, mine].sum(axis=1) > len(mine) for mine in own]
        out.append((voted[0] != voted[1]).sum(axis=1))
    return np.concatenate(out)


def _pairs_at(similarity: float, bits: int) -> list[np.ndarray]:
    """Distances at just the similarity: equally large and nested sets, large, small and the smallest that shards must find."""
    out = []
    for union in (200, 20, small_sets(similarity) + 1):
        common = math.ceil(similarity * union - _EPSILON)
        for left in ((union - common) // 2, 0):
            out.append(simulated_distances(common, left, union - common - left, bits))
    return out


def small_sets(similarity: float) -> int:
    """Two different sets of so many shingles together, or fewer, reach the similarity only if one is the other and one shingle more."""
    return max(1, math.ceil(2 / (1 - similarity) - _EPSILON) - 1) if similarity < 1 else 1


def candidate_recall(distances: np.ndarray, bits: int, size: int, tables: int, radius: int) -> float:
    """Share of pairs at these distances that lie within the radius and agree on all bits of one table at least."""
    agree = np.array([math.prod((bits - d - k) / (bits - k) for k in range(size)) if d <= bits - size else 0.0 for d in range(bits + 1)])
    return float(((distances <= radius) * (1 - (1 - agree[distances]) ** tables)).mean())


def sampled_tables(bits: int, similarity: float, rows: int, recall: float = RECALL, seed: int = 17) -> tuple[list[np.ndarray], int]:
    """Random bit positions of each table, and the radius within which a pair is a candidate.

    Shards hold about 16 of ``rows`` fingerprints. The radius leaves out one in 60 of the pairs at just the similarity,
    whatever their sizes, and there are as many tables as bring ``recall`` of them together: both are solved
    over simulated distances and not over the expected one.
    """
    size = min(40, max(8, round(math.log2(max(rows, 1) / 16 + 1))))
    distances = _pairs_at(similarity, bits)
    radius = max(round(float(np.quantile(d, 1 - 1 / 60))) for d in distances)
    tables, rng = 1, np.random.default_rng(seed)
    while min(candidate_recall(d, bits, size, tables, radius) for d in distances) < recall:
        tables = tables + 1 + tables // 50
    return [rng.choice(bits, size, replace=False) for _ in range(tables)], radius


class BKTree:
    """Integers under Hamming distance; children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self._value: list[int] = []
        self._children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Stored values at ``radius`` differing bits or fewer."""
        found, open_nodes = [], [0] if self._value else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (value ^ self._value[node]).bit_count()
            if distance <= radius:
                found.append(self._value[node])
            open_nodes += [c for d, c in self._children[node].items() if distance - radius <= d <= distance + radius]
        return found

    def add(self, value: int) -> None:
        if self._value:
            node = 0
            while True:
                distance = (value ^ self._value[node]).bit_count()
                following = self._children[node].get(distance)
                if following is None:
                    self._children[node][distance] = len(self._value)
                    break
                node = following
        self._value.append(value)
        self._children.append({})


def _shard_links(left: list[tuple[int, int]], right: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius: within ``left``, or from ``right`` to ``left``."""
    tree, root = BKTree(), {node: node for node, _ in left} | {node: node for node, _ in right or ()}
    node_of = {value: node for node, value in left}

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def join(node: int, value: int) -> None:
        for match in tree.within(value, radius):
            a, b = top(node), top(node_of[match])
            if a != b:
                root[max(a, b)] = min(a, b)

    for node, value in left:
        if right is None:
            join(node, value)
        tree.add(value)
    for node, value in right or ():
        join(node, value)
    return [(v, t) for v in root if (t := top(v)) != v]


def _dealt(distinct: DataFrame, tables: list[np.ndarray], shard_rows: int) -> DataFrame:
    """The rows of ``distinct``, once for each table, in the order of their work units ``(shard, low, high)``."""

    def keys(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_pylist()
            own = {name: batch.column(name) for name in batch.schema.names}
            bit = np.unpackbits(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1), axis=1, bitorder="big").astype(np.int64)
            for t, places in enumerate(tables):
                yield own | {"shard": (t << 48) + bit[:, places] @ (1 << np.arange(len(places)))}

    kinds = ", ".join(f"{name} {kind}" for name, kind in distinct.dtypes)
    paired = chunk_pairs(map_arrow(distinct, f"shard long, {kinds}", keys), "shard", "node", shard_rows)
    parts = shuffle_partitions(distinct.sparkSession)
    return paired.repartition(parts, "shard", "low", "high").sortWithinPartitions("shard", "low", "high", "node")


def _by_unit(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list[tuple], list[tuple] | None]]:
    """``(left, right)`` rows of each work unit of two rows or more; ``right`` is None in a unit of one chunk."""
    unit, left, right = None, [], []

    def whole():
        if unit and len(left) + len(right) > 1:
            yield left, None if unit[1] == unit[2] else right

    for batch in batches:
        units = (batch.column(c).to_pylist() for c in ("shard", "low", "high", "first"))
        rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
        for key, low, high, first, row in zip(*units, rows, strict=True):
            if (key, low, high) != unit:
                yield from whole()
                unit, left, right = (key, low, high), [], []
            (left if first else right).append(row)
    yield from whole()


def links(distinct: DataFrame, tables: list[np.ndarray], radius: int, shard_rows: int = 2000) -> DataFrame:
    """Edges ``(a, b)`` of nodes that connect the distinct ``(node, fp)`` within the radius."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for sides in _by_unit(batches, ("node", "fp")):
            left, right = ([(node, int.from_bytes(fp)) for node, fp in side] if side is not None else None for side in sides)
            if found := _shard_links(left, right, radius):
                yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    return map_arrow(_dealt(distinct.select("node", "fp"), tables, shard_rows), "a long, b long", rows).distinct()


def _near_pairs(left: list[tuple], right: list[tuple] | None, radius: int, similarity: float, earlier: list[int]) -> Iterator[tuple[tuple, tuple]]:
    """Pairs of rows ``(node, fp, size, label, ...)`` within the radius whose sizes allow the similarity and whose labels differ, each row's nearest first.

    Pairs that agree on all bits of one of the masks ``earlier`` are left to another shard.
    """
    tree, members = BKTree(), {}

    def matches(row: tuple) -> Iterator[tuple[tuple, tuple]]:
        value, size, label = int.from_bytes(row[1]), row[2], row[3]
        for near in sorted(tree.within(value, radius), key=lambda v: ((v ^ value).bit_count(), v)):
            different = near ^ value
            if any(not different & mask for mask in earlier):
                continue
            for other in members[near]:
                if other[0] != row[0] and other[3] != label and min(size, other[2]) >= similarity * max(size, other[2]) - _EPSILON:
                    yield row, other

    def add(row: tuple) -> None:
        value = int.from_bytes(row[1])
        if value not in members:
            members[value] = []
            tree.add(value)
        members[value].append(row)

    for row in left:
        if right is None:
            yield from matches(row)
        add(row)
    for row in right or ():
        yield from matches(row)


class _Roots(dict):
    """A forest over labels: ``join`` tells whether two were apart."""

    def top(self, v: int) -> int:
        while (above := self.setdefault(v, v)) != v:
            self[v] = self.setdefault(above, above)
            v = self[v]
        return v

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def spanning_candidates(distinct: DataFrame, tables: list[np.ndarray], radius: int, similarity: float, shard_rows: int = 2000) -> DataFrame:
    """Distinct pairs ``(a, b)``, ``a < b``, of the nodes of ``(node, fp, size, label)`` that may have the similarity: a spanning forest of each shard."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for left, right in _by_unit(batches, ("node", "fp", "size", "label")):
            roots = _Roots()
            found = [sorted((x[0], y[0])) for x, y in _near_pairs(left, right, radius, similarity, []) if roots.join(x[0], y[0])]
            if found:
                yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    return map_arrow(_dealt(distinct.select("node", "fp", "size", "label"), tables, shard_rows), "a long, b long", rows).distinct()


def unsettled(distinct: DataFrame, tables: list[np.ndarray], radius: int, similarity: float, shard_rows: int = 1000) -> DataFrame:
    """The rows of each work unit whose labels differ from those of a candidate in it: ``(shard, low, high, first, node, fp, size, label)``.

    A pair counts in the first table alone that holds both in one shard. Rows are
    written, and not their pairs, so they grow with the nodes.
    """
    masks = _masks(tables, distinct)

    def rows(batches: Iterator[pa.RecordBatch]):
        for left, right in _by_unit(batches, ("node", "fp", "size", "label", "shard", "low", "high", "first")):
            table = left[0][4] >> 48 if left else 0
            open_rows = {row[0]: row for pair in _near_pairs(left, right, radius, similarity, masks[:table]) for row in pair}
            if open_rows:
                columns = list(zip(*open_rows.values(), strict=True))
                yield dict(zip(("node", "fp", "size", "label", "shard", "low", "high", "first"), columns, strict=True))

    dealt = _dealt(distinct.select("node", "fp", "size", "label"), tables, shard_rows)
    return map_arrow(dealt, "node long, fp binary, size long, label long, shard long, low int, high int, first boolean", rows)


def _masks(tables: list[np.ndarray], distinct: DataFrame) -> list[int]:
    """The bits of each table as they lie in a fingerprint's number."""
    row = distinct.select("fp").first()
    bits = 8 * len(row[0]) if row else 0
    return [sum(1 << (bits - 1 - int(at)) for at in places) for places in tables] if bits else []


def settled(members: DataFrame, sets: DataFrame, tables: list[np.ndarray], radius: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` among the rows of ``unsettled`` by their exact similarity; of a unit's, those that join what is apart.

    The shingle sets ``(node, shingles)`` travel to the units, once for each unit of a node.
    """
    masks = _masks(tables, members)
    units = ("shard", "low", "high")
    dealt = members.join(sets, "node").repartition(shuffle_partitions(members.sparkSession), *units).sortWithinPartitions(*units, "node")

    def rows(batches: Iterator[pa.RecordBatch]):
        for left, right in _by_unit(batches, ("node", "fp", "size", "label", "shingles", "shard")):
            roots, out = _Roots(), {"a": [], "b": []}
            table = (left or right)[0][5] >> 48
            for x, y in _near_pairs(left, right, radius, similarity, masks[:table]):
                if roots.top(x[3]) != roots.top(y[3]) and _alike(x[4], y[4], similarity):
                    roots.join(x[3], y[3])
                    out["a"].append(x[0])
                    out["b"].append(y[0])
            yield out

    return map_arrow(dealt, "a long, b long", rows).distinct()


def _alike(left: bytes, right: bytes, similarity: float) -> bool:
    """Whether two sets of shingle hashes have that Jaccard similarity, or more."""
    a, b = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - _EPSILON


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)`` of ``(node, text)``: the distinct shingle hashes, ascending, 8 bytes each."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                yield {"node": batch.column("node").slice(k, _ROWS), "shingles": [shingle_set(t, words).astype("<u8").tobytes() for t in batch.column("text").slice(k, _ROWS).to_pylist()]}

    return map_arrow(texts, "node long, shingles binary", rows)


def one_more(sets: DataFrame) -> DataFrame:
    """``(a, b)`` of the nodes of ``(node, shingles)`` of which one is the other and one shingle more: each set against all sets less a shingle."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: dict[str, list] = {"node": [], "key": [], "whole": []}
            for node, data in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                parts = [data] + [data[:k] + data[k + 8 :] for k in range(0, len(data), 8) if len(data) > 8]
                out["node"] += [node] * len(parts)
                out["key"] += [xxhash.xxh3_128_digest(p) for p in parts]
                out["whole"] += [True] + [False] * (len(parts) - 1)
            yield out

    keyed = stored(map_arrow(sets.select("node", "shingles"), "node long, key binary, whole boolean", rows), "simhash-one-more")
    less = keyed.where("not whole").select(F.col("node").alias("other"), "key")
    met = keyed.where("whole").join(less, "key")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` ``(a, b)`` whose shingle sets have that Jaccard similarity, or more."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = [_alike(x, y, similarity) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield {"a": kept.column("a"), "b": kept.column("b")}

    return map_arrow(both.select("a", "b", "left", "right"), "a long, b long", rows)


def _first_row(doc_id: str, text_key: str):
    """Orders rows by id, those without one last, then by the hash of their text."""
    return F.struct(F.col(doc_id).isNull().alias("absent"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col(text_key).alias("text_key"))


def _similar_kept(marked: DataFrame, docs: DataFrame, words: int, similarity: float, bits: int, shard_rows: int) -> DataFrame:
    """``(absent, id, text_key)`` of the first row of each group; ``docs`` are ``(doc_id, text_key, text)``.

    Nodes are the distinct shingle sets, numbered as they are stored, so rows that
    share an id but not a text are in groups of their own.
    """
    kinds = marked.groupBy("set_key", "fp", "size").agg(F.min(_first_row("doc_id", "text_key")).alias("first"))
    distinct = stored(kinds.select(F.monotonically_increasing_id().alias("node"), "fp", "size", "first"), "simhash-distinct")
    labelled = distinct.select("node", "fp", "size", F.col("node").alias("label"))
    tables, radius = sampled_tables(bits, similarity, distinct.count())
    first = stored(spanning_candidates(labelled, tables, radius, similarity, shard_rows), "simhash-candidates")
    few = F.col("size").between(1, small_sets(similarity))
    met = first.select(F.col("a").alias("node")).union(first.select("b")).union(distinct.where(few).select("node")).distinct()
    wanted = distinct.join(met, "node").select("node", "first.*")
    keyed = docs.select(_first_row("doc_id", "text_key").alias("first"), "text").select("first.*", "text")
    texts = keyed.join(wanted, ["absent", "id", "text_key"]).select("node", "text")
    sets = stored(shingle_sets(texts, words).dropDuplicates(["node"]), "simhash-sets")
    # pairs that differ by one shingle are many from one small set only where they all link to it, so they are written
    first = first.union(one_more(sets.join(distinct.where(few).select("node"), "node")))
    found = stored(similar(first, sets, similarity), "simhash-links")
    groups = components(found)
    # a node without any candidate in the first round has none in the second
    apart = distinct.select("node", "fp", "size").join(met, "node").join(groups, "node", "left").withColumn("label", F.coalesce("root", "node"))
    members = stored(unsettled(stored(apart.drop("root"), "simhash-apart"), tables, radius, similarity, max(2, shard_rows // 2)), "simhash-unsettled")
    more = stored(settled(members, sets, tables, radius, similarity), "simhash-links")
    if not more.isEmpty():
        groups = components(found.union(more))
    return distinct.join(groups, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select("first.*")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: the smallest id reachable through links of 64-bit fingerprints."""
    marked = stored(fingerprints(docs, words, 64, False, id_column, text_column), "simhash")
    # a node is the fingerprint itself, so that rows with one id and different texts are nodes of their own
    node = F.conv(F.hex("fp"), 16, -10).cast("long")
    classes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", node)
    distinct = stored(classes, "simhash-distinct")
    groups = components(links(distinct, block_tables(64, radius, distinct.count()), radius))
    rooted = distinct.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")).select("fp", "root", "first")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    out = marked.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp", "left")
    return out.select(
        F.col("doc_id").alias(id_column),
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def one_of_each_group(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 256, id_column: str = "doc_id", text_column: str = "text", shard_rows: int = 2000
) -> DataFrame:
    """One row of ``docs`` for each group of texts of that similarity or more: that with the smallest id.

    Two texts link if the Jaccard similarity of their distinct shingles is
    ``similarity`` or more; texts without shingles are alike. Of the pairs at just the
    similarity ``RECALL`` are candidates, of nearer ones more (``sampled_tables``). Rows that share an id are grouped by their own texts; rows without an
    id come after all others; of equal rows one stays. All columns stay, whatever their names.
    """
    marked = stored(fingerprints(docs, words, bits, False, id_column, text_column, distinct=True), "simhash")
    keyed = _keyed(docs, id_column, text_column)
    kept = _similar_kept(marked, keyed, words, similarity, bits, shard_rows)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    rows = rows.select("doc", _first_row("doc_id", "text_key").alias("first")).select("doc", "first.*")
    keys = ["absent", "id", "text_key"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.hash("doc")))
    return rows.join(kept, keys).withColumn("number", number).where("number = 1").select("doc.*")
