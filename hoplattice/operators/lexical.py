"""Lexical retrieval: BM25 and weighted term overlap of a query set against all documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplattice.operators.rank import top_k
from hoplattice.sources.tables import Pieces, spread, stored

#: Queries, and distinct terms of queries, that are broadcast and scored side by side.
BLOCK, ENTRIES = 1_024, 4_000_000
_UNITS, _PULLED = 1_024, 1 << 21

# The ranking's constants and its English stop words.
K1, B = 1.5, 0.75
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def terms(text: Column) -> Column:
    """Lower-case ASCII words of two characters or more, stop words left out, with repeats."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def postings(docs: DataFrame, wanted: dict[str, int], id_column: str, text_column: str) -> DataFrame:
    """``(unit_id, dl, term, tf)``: each unit's wanted terms, by their numbers, and how often it holds them; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    words = spread(docs.select(F.col(id_column).cast("long").alias("unit_id"), F.col(text_column).alias("text"))).select("unit_id", terms(F.col("text")).alias("words"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            words = batch.column("words").to_pylist()
            held = [Counter(number[w] for w in ws or () if w in number) for ws in words]
            columns = [
                batch.column("unit_id"), pa.array([len(ws or ()) for ws in words], pa.int32()),
                pa.array([list(h.keys()) for h in held], pa.list_(pa.int32())), pa.array([list(h.values()) for h in held], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["unit_id", "dl", "term", "tf"])

    return words.mapInArrow(counted, "unit_id long, dl int, term array<int>, tf array<int>")


#: Rates by term: where each term's entries begin, their queries' places, and the rates; zeros are not held.
Rates = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sparse(entries: list[tuple[int, int, float]], terms: int) -> Rates:
    """``(term, place, rate)`` entries in the order of the terms."""
    term, place, rate = (np.array(c, t) for c, t in zip(zip(*entries, strict=True), (np.int64, np.int64, float), strict=True)) if entries else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((place, term))
    return np.searchsorted(term[order], np.arange(terms + 1)), place[order], rate[order]


def _blocks(asked: Iterator) -> Iterator[list[tuple[int, Counter]]]:
    """``(qid, terms)`` in runs of ``BLOCK`` queries and ``ENTRIES`` distinct terms at most; a query beyond that is a run of its own."""
    run: list[tuple[int, Counter]] = []
    size = 0
    for r in asked:
        count = Counter(r["words"] or ())
        if run and (len(run) == BLOCK or size + len(count) > ENTRIES):
            yield run
            run, size = [], 0
        run.append((r["qid"], count))
        size += len(count)
    if run:
        yield run


def _best(found: DataFrame, qids: list[int], rates: Rates, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> DataFrame:
    """``(qid, unit_id, score)``: of each task's units the ``k`` best of each query, and what ties with the last.

    A unit's score is the sum over its terms of ``weight(tf, dl)`` times the term's
    entries of ``rates``; scores of 0 or less are left out.
    """
    shared = found.sparkSession.sparkContext.broadcast((np.array(qids, np.int64), rates))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (start, place, rate) = shared.value
        held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def cut() -> tuple[np.ndarray, ...]:
            query, unit, score = held
            order = np.lexsort((unit, -score, query))
            query, unit, score = query[order], unit[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            keep = place < k
            return query[keep], unit[keep], score[keep]

        for batch in batches:
            for at in range(0, batch.num_rows, _UNITS):
                part = batch.slice(at, _UNITS)
                units = np.asarray(part.column("unit_id"))
                n = np.asarray(part.column("term").value_lengths())
                owner = np.repeat(np.arange(len(units)), n)
                term, tf = (np.asarray(part.column(c).flatten()) for c in ("term", "tf"))
                values = weight(tf.astype(float), np.asarray(part.column("dl"), float)[owner])
                total = np.zeros(len(units) * len(asked))
                width = start[term + 1] - start[term]  # a posting meets its term's queries and no others
                ends = np.cumsum(width)
                cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, _PULLED), "right")
                for a, b in pairwise([*cuts.tolist(), len(term)]):
                    w = width[a:b]
                    entry = np.repeat(start[term[a:b]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                    total += np.bincount(np.repeat(owner[a:b], w) * len(asked) + place[entry], np.repeat(values[a:b], w) * rate[entry], len(total))
                score = np.round(total.reshape(len(units), len(asked)), 6)
                unit, query = np.nonzero(score > 0)
                new = (asked[query], units[unit], score[unit, query])
                held = tuple(np.concatenate(pair) for pair in zip(held, new, strict=True))
                if len(held[0]) > 4 * k * len(asked):
                    held = cut()
        held = cut()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["qid", "unit_id", "score"])

    return found.mapInArrow(best, "qid long, unit_id long, score double")


def _ranked(queries: DataFrame, docs: DataFrame, k: int, id_column: str, text_column: str, rate: Callable, weight: Callable) -> DataFrame:
    """Top ``k`` of each query, block by block; ``rate(qtf, df, n)`` of a term in a query, ``weight(tf, dl, mean length)`` of a posting."""
    spark = docs.sparkSession
    asked = queries.select("qid", terms(F.col("query")).alias("words")).toLocalIterator()
    out = Pieces(spark, "qid long, unit_id long, score double, rank int", "lexical")
    for block in _blocks(asked):
        counts = [count for _, count in block]
        wanted = {w: number for number, w in enumerate(sorted(set().union(*counts)))}
        # both the frequencies and the scores read the postings, which are made once
        found = stored(postings(docs, wanted, id_column, text_column), "postings")
        total = found.agg(F.count("*").alias("n"), F.avg("dl").alias("length")).first()
        # one row a wanted term
        df = {r["t"]: r["df"] for r in found.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        entries = [(wanted[w], j, rate(qtf, df[wanted[w]], total["n"])) for j, count in enumerate(counts) for w, qtf in count.items() if wanted[w] in df]
        mean = total["length"] or 1.0
        best = _best(found, [q for q, _ in block], _sparse(entries, len(wanted)), lambda tf, dl, mean=mean: weight(tf, dl, mean), k)
        out.add(top_k(best, k).select("qid", "unit_id", "score", "rank"))
    return out.read()


def bm25(queries: DataFrame, docs: DataFrame, k: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Top ``k`` of each query ``(qid, query)``: only positive scores; each occurrence in the query counts.

    Query terms are broadcast in blocks of queries; documents are read once a block,
    scored where they are, and only each task's best are shuffled.
    """
    rate = lambda qtf, df, n: qtf * math.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = lambda tf, dl, mean: tf / (tf + K1 * (1 - B + B * dl / mean))
    return _ranked(queries, docs, k, id_column, text_column, rate, weight)


def overlap(queries: DataFrame, docs: DataFrame, k: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Top ``k`` by the rarity of shared distinct terms, ``sum log1p(N / (1 + df))``."""
    rate = lambda qtf, df, n: float(np.float32(math.log1p(n / (1 + df))))
    return _ranked(queries, docs, k, id_column, text_column, rate, lambda tf, dl, mean: np.ones_like(tf))
