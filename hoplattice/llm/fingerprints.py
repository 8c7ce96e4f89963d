"""Document fingerprints: SimHash of weighted terms, and the search for near fingerprints.

A term is a pair of neighbouring words (the only word, if there is one). Each
occurrence votes with the number of bytes of its words (63 at most each) on 128
signed bits, so rare long words outweigh common short ones. The likeness of two fingerprints is
the cosine that their Hamming distance estimates, 0 at least.

Defined cases: a null text is empty; an empty text has fingerprint zero; equal
texts have equal fingerprints; rows with one id are ordered by their text; a
null id counts as the smallest; an empty table gives no rows. Other columns are
not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplattice.llm import votes
from hoplattice.llm.common import map_arrow, shuffle_partitions

BITS = 128
_MEMO_WORDS = 400_000
_MEMO_BYTES = 32 << 20
_LEAST_ID = -(2**63)


class TermHasher:
    """Fingerprints of texts; remembers word hashes, a bounded number of them."""

    def __init__(self) -> None:
        self._index: dict[bytes, int] = {}
        self._hash: list[int] = []
        self._bytes = 0

    def _words(self, text: str) -> list[int]:
        out = []
        index, hashes = self._index, self._hash
        for word in text.encode().lower().split():
            at = index.get(word)
            if at is None:
                at = index[word] = len(hashes)
                self._bytes += len(word)
                hashes.append(xxhash.xxh64_intdigest(word, 1) & ~0x3F | min(len(word), 63))  # low six bits: length
            out.append(at)
        return out

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """Two 64-bit halves for each text."""
        if len(self._index) > _MEMO_WORDS or self._bytes > _MEMO_BYTES:
            self.__init__()
        per_text = [self._words(t) for t in texts]
        count = np.array([len(w) for w in per_text], dtype=np.int64)
        flat = np.fromiter((i for w in per_text for i in w), dtype=np.int64, count=int(count.sum()))
        group = np.repeat(np.arange(len(texts)), count)
        word = np.array(self._hash, dtype=np.uint64)[flat]
        following = np.zeros_like(word)
        following[:-1] = word[1:]
        last = np.zeros(len(word), dtype=bool)
        last[(np.cumsum(count) - 1)[count > 0]] = True
        only = last & (count[group] == 1)
        following[only] = 0
        keep = ~last | only
        first, second, group = word[keep], following[keep], group[keep]
        weight = ((first & np.uint64(0x3F)) + (second & np.uint64(0x3F))).astype(np.float64)
        total = np.bincount(group, weights=weight, minlength=len(texts))
        halves = []
        for a, b in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            mixed = first * np.uint64(a) + (second ^ (second >> np.uint64(29))) * np.uint64(b)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(a)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(b)
            mixed ^= mixed >> np.uint64(32)
            halves.append(votes.majority(votes.ones(group, mixed, len(texts), weight), total))
        return np.stack(halves, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: the cosine estimated from the share of differing bits, 0 at least."""
    different = np.bitwise_count(a ^ b).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * different / BITS))


def _as_text(row: np.ndarray) -> str:
    return f"{int(row[0]):016x}{int(row[1]):016x}"


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, fingerprint)``: 32 hexadecimal digits per row, without any shuffle."""
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        hasher = TermHasher()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 64):
                found = hasher.fingerprints(texts[k : k + 64])
                yield {"id": batch.column("id").slice(k, 64), "fingerprint": [_as_text(f) for f in found]}

    kind = dict(source.dtypes)["id"]
    return map_arrow(source, f"id {kind}, fingerprint string", rows).withColumnRenamed("id", id_column)


def _halves(fingerprint: str) -> tuple[Column, Column]:
    return tuple(F.conv(F.substring(fingerprint, at, 16), 16, -10).cast("long") for at in (1, 17))


def _masks(blocks: int) -> list[tuple[int, int]]:
    """For each block of neighbouring bits its mask in either half, as signed longs."""
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    whole = [(1 << (BITS - a)) - (1 << (BITS - b)) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in whole]


def within_radius(
    queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int | None = None, id_column: str = "doc_id"
) -> DataFrame:
    """All ``(query, match, distance)`` at ``radius`` differing bits or fewer, by permuted block tables.

    The 128 bits are cut into ``blocks`` blocks, more than ``radius`` (``radius + 1`` by
    default), so that two fingerprints within the radius agree on a whole block. Each
    table holds the fingerprints keyed by another block; candidates share a key and
    are then verified. Both sides are first reduced to their distinct fingerprints, so
    copies cost nothing; ``match`` is a distinct fingerprint, to be joined to rows
    by the caller. A pair found in several tables is kept in the first of them.
    """
    n = radius + 1 if blocks is None else blocks
    if n <= radius or n > BITS:
        raise ValueError(f"{n} blocks do not find all pairs within {radius} bits: more than {radius} and at most {BITS} are needed")
    masks = _masks(n)

    def keyed(df: DataFrame, side: str) -> DataFrame:
        high, low = (F.col(f"{side}_{half}") for half in ("high", "low"))
        tables = [F.struct(F.lit(k).alias("block"), high.bitwiseAND(a).alias("high"), low.bitwiseAND(b).alias("low")) for k, (a, b) in enumerate(masks)]
        halves = df.select("fingerprint").distinct().select(*(c.alias(f"{side}_{half}") for c, half in zip(_halves("fingerprint"), ("high", "low"), strict=True)))
        return halves.withColumn("key", F.explode(F.array(*tables))).select(f"{side}_high", f"{side}_low", "key.*")

    high, low = (F.col(f"query_{half}").bitwiseXOR(F.col(f"match_{half}")) for half in ("high", "low"))
    first = F.coalesce(*(F.when((high.bitwiseAND(a) == 0) & (low.bitwiseAND(b) == 0), F.lit(k)) for k, (a, b) in enumerate(masks)))
    distance = F.bit_count(high) + F.bit_count(low)
    pairs = keyed(queries, "query").join(keyed(fingerprints, "match"), ["block", "high", "low"]).where((distance <= radius) & (first == F.col("block")))
    digits = F.lower(F.concat(*(F.lpad(F.hex(f"match_{half}"), 16, "0") for half in ("high", "low"))))
    pairs = pairs.select("query_high", "query_low", digits.alias("match"), distance.cast("int").alias("distance"))
    rows = queries.select(F.col(id_column).alias("query"), *(c.alias(f"query_{half}") for c, half in zip(_halves("fingerprint"), ("high", "low"), strict=True)))
    return rows.join(pairs, ["query_high", "query_low"]).select("query", "match", "distance")


def with_neighbours(marked: DataFrame, queries: str, radius: int = 3, id_column: str = "doc_id") -> DataFrame:
    """``marked`` with ``n_within``: for the rows where SQL ``queries`` holds, the rows whose fingerprint lies within the radius, itself included; else null.

    ``marked`` is read several times, so it is best a stored table.
    """
    asked = marked.where(queries).select(id_column, "fingerprint")
    copies = marked.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    found = within_radius(asked.distinct(), copies, radius, id_column=id_column).join(copies, F.col("match") == F.col("fingerprint"))
    counts = found.groupBy(F.col("query").alias("_query"), "match").agg(F.max("copies").alias("copies")).groupBy("_query").agg(F.sum("copies").alias("n_within"))
    return marked.join(counts, F.col(id_column) == F.col("_query"), "left").drop("_query")


def _with_buckets(docs: DataFrame, n: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows dealt into buckets of id ranges, and (smallest id, bucket, bucket before it) of each that has rows."""
    bounds = docs.select(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = np.array(sorted(set(bounds)), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(dtype=np.int64), side="right"))

    heads = docs.select("id", bucket_of("id").alias("bucket")).groupBy("bucket").agg(F.min("id").alias("head")).collect()
    found = sorted((r["head"], r["bucket"]) for r in heads)
    before = [(head, bucket, found[k - 1][1]) for k, (head, bucket) in enumerate(found)]
    return docs.withColumn("bucket", bucket_of("id")), before


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last quarter of the code points replaced by the start
    of the next document by id (the first follows the last). Documents are dealt
    into id ranges; the first document of each range is sent to the range before
    it as well, so each range is finished alone in one streamed pass.
    """
    source = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(_LEAST_ID)).alias("id"),
        F.col(id_column).isNotNull().alias("known"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    n = shuffle_partitions(docs.sparkSession)
    dealt, heads = _with_buckets(source, n)
    copies = dealt.where(F.col("id").isin([h for h, _, _ in heads]))
    # of rows that share the smallest id, the one with the smallest text comes first
    copies = copies.groupBy("id").agg(F.min("text").alias("text"))
    move = F.create_map(*(F.lit(x) for h, _, b in heads for x in (h, b))) if heads else F.lit(None)
    copies = copies.select("id", F.lit(True).alias("known"), "text", move[F.col("id")].cast("int").alias("bucket") if heads else F.lit(0).alias("bucket"))
    both = dealt.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    ordered = both.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", "id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(batches: Iterator[pa.RecordBatch]):
        hasher = TermHasher()
        waiting: list[tuple[int | None, str]] = []  # documents whose next one is known, and the last one, whose isn't

        def done():
            texts = [t for _, t in waiting]
            edited = []
            for text, following in zip(texts, texts[1:], strict=False):
                cut = len(text) // 4
                edited.append(text[: len(text) - cut] + following[:cut])
            found = hasher.fingerprints(texts + edited)
            own, other, changed = found[: len(edited)], found[1 : len(texts)], found[len(texts) :]
            return {
                "doc_id": [i for i, _ in waiting[:-1]],
                "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [_as_text(f) for f in own],
                "edited_fingerprint": [_as_text(f) for f in changed],
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, other),
            }

        size = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("id", "known", "text", "copy"))
            for i, known, text, copy in zip(*columns, strict=True):
                waiting.append((i if known else None, text))
                size += len(text)
                if copy or len(waiting) > 64 or size > 4_000_000:
                    if len(waiting) > 1:
                        yield done()
                    waiting = [] if copy else waiting[-1:]
                    size = 0

    out = map_arrow(ordered.select("id", "known", "text", "copy"), schema, rows)
    return out.withColumnRenamed("doc_id", id_column)
