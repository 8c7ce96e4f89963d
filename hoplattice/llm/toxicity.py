"""Toxicity: a factorization machine over hashed terms.

A document's features are the distinct hashed terms it holds. Its score is
``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``: besides the weight of each term,
a learned product for each pair of them, so that two terms may be toxic together
which are not alone. The model is fitted on a bounded sample of labelled rows
(``sample_rows``, taken in hash order of the id) by AdaGrad on the log loss; of the
sample's terms ``max_terms`` at most stay, those whose document counts differ between
the labels, alone or beside another term. Scoring reads every whole text and shuffles nothing.

Defined cases: a null or empty text has no terms and gets the model's base rate;
without labels of both kinds the score is the share of toxic labels (0 without
any); of several labels of one id the largest counts, of several texts the first by terms; rows with a null id are
scored and held out; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.llm.common import LONG_WORD, bounded_batches, held_out_column, map_arrow

SAMPLE_ROWS = 16_384
MAX_TERMS = 8_192
FACTORS = 8
#: Terms without a difference of their own that are counted in pairs, and the least difference of a pair: one in 2 * 10^9 by chance.
PAIRED = 1_024
PAIR_DIFFERENCE = 36.0
THRESHOLD = 0.7
_HASH_BITS = 28
_MEMO_WORDS = 400_000
_EDGES = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def _term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.strip(_EDGES), 7) >> (64 - _HASH_BITS)


@dataclass
class FactorizationMachine:
    """Terms in ascending order with their weights and factors."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of each row of distinct term positions."""
        count = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), count)
        total = self.bias + np.bincount(row, weights=self.weights[flat], minlength=len(rows))
        for k in range(self.factors.shape[1]):
            v = self.factors[flat, k]
            total += 0.5 * (np.bincount(row, weights=v, minlength=len(rows)) ** 2 - np.bincount(row, weights=v * v, minlength=len(rows)))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _differing(toxic: np.ndarray, both: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Pearson's statistic of ``toxic`` out of ``both`` documents where ``rate`` are expected."""
    return (toxic - both * rate) ** 2 / np.maximum(both * rate * (1 - rate), 1e-9)


def _selected(rows: list[np.ndarray], label: np.ndarray, max_terms: int) -> np.ndarray:
    """Terms whose document counts differ between the labels, and those that make a difference only beside another term.

    For the second, the ``PAIRED`` most frequent terms without a difference of their own
    are counted beside each other and beside as many of the first kind: a pair counts
    if its documents' labels differ from the rate that its first term alone lets expect.
    """
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    terms, place = np.unique(flat, return_inverse=True)
    both = np.bincount(place).astype(float)
    toxic = np.bincount(place, weights=label[row] > 0)
    n, p = len(rows), label.mean()
    chi = _differing(toxic, both, p) / np.maximum(1 - both / n, 1e-9)
    single = (chi > 12) & (both >= 3)
    strongest = np.flatnonzero(single)[np.lexsort((np.flatnonzero(single), -chi[single]))]
    others = np.flatnonzero(~single & (both >= 8))
    others = np.sort(others[np.argsort(-both[others], kind="stable")[:PAIRED]])
    beside = np.concatenate([others, np.sort(strongest[:PAIRED])])
    column = np.full(len(terms), -1)
    column[beside] = np.arange(len(beside))
    held = np.zeros((n, len(beside)), np.float32)
    inside = column[place] >= 0
    held[row[inside], column[place[inside]]] = 1
    paired = held.T @ held[:, : len(others)]
    toxic_paired = held[label > 0].T @ held[label > 0][:, : len(others)]
    rate = np.concatenate([np.full(len(others), p), toxic[beside[len(others) :]] / both[beside[len(others) :]]])[:, None]
    found = (_differing(toxic_paired, paired, rate) > PAIR_DIFFERENCE) & (paired >= 8)
    found[np.arange(len(others)), np.arange(len(others))] = False
    joined = others[found.any(axis=0)]
    return np.sort(terms[np.concatenate([joined, strongest])[:max_terms]])


def train(rows: list[np.ndarray], label: np.ndarray, max_terms: int = MAX_TERMS, factors: int = FACTORS, epochs: int = 40, seed: int = 5) -> FactorizationMachine:
    """Fit on rows of distinct term hashes with labels 0 and 1."""
    if not len(label) or label.min() == label.max():
        rate = float(label.mean()) if len(label) else 0.0
        bias = 40.0 if rate == 1 else -40.0
        return FactorizationMachine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    terms = _selected(rows, label, max_terms)
    inside = [np.searchsorted(terms, r[np.isin(r, terms, assume_unique=True)]) for r in rows]
    rng = np.random.default_rng(seed)
    rate = label.mean()
    bias, w, v = float(np.log(rate / (1 - rate))), np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), factors))
    seen_b, seen_w, seen_v = 1.0, np.full(len(terms), 0.1), np.full((len(terms), factors), 0.1)
    weight = np.where(label > 0, np.sqrt((1 - rate) / rate), 1.0)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            own = [inside[k] for k in part]
            row, flat = np.repeat(np.arange(len(part)), [len(r) for r in own]), np.concatenate(own)
            sums = np.stack([np.bincount(row, weights=v[flat, k], minlength=len(part)) for k in range(factors)], axis=1)
            squares = np.bincount(row, weights=(v[flat] ** 2).sum(axis=1), minlength=len(part))
            z = bias + np.bincount(row, weights=w[flat], minlength=len(part)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[part]) * weight[part] / len(part)
            seen_b += g.sum() ** 2
            bias -= 0.2 * g.sum() / np.sqrt(seen_b)
            gw = np.bincount(flat, weights=g[row], minlength=len(terms)) + 1e-5 * w
            seen_w += gw**2 * len(part)
            w -= 0.3 * gw * np.sqrt(len(part)) / np.sqrt(seen_w)
            touched = np.unique(flat)
            pull = g[row, None] * (sums[row] - v[flat])
            gv = np.stack([np.bincount(flat, weights=pull[:, k], minlength=len(terms))[touched] for k in range(factors)], axis=1) + 1e-4 * v[touched]
            seen_v[touched] += gv**2 * len(part)
            v[touched] -= 0.1 * gv * np.sqrt(len(part)) / np.sqrt(seen_v[touched])
    return FactorizationMachine(bias, terms, w, v)


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), sample_rows: int = SAMPLE_ROWS, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> FactorizationMachine:
    """Fit on ``sample_rows`` labelled rows at most, none of them held out.

    The sampled ids, bounded by ``sample_rows``, are broadcast to the documents;
    one task gathers the sampled rows' term hashes, and trains.
    """
    known = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.where(f"id is not null and label is not null and not {held_out_column('id', *held_out)}")
    sample = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), "id").select("id", "text", "label")

    def hashed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            terms = [np.unique(np.array([_term(w) for w in set(t.encode().lower().split())], np.int64)) for t in batch.column("text").to_pylist()]
            yield {"id": batch.column("id"), "label": batch.column("label"), "terms": [t.astype("<i4").tobytes() for t in terms]}

    # one row an id, so that the rows are as bounded as the ids
    once = map_arrow(chosen, "id long, label int, terms binary", hashed).groupBy("id", "label").agg(F.min("terms").alias("terms"))
    gathered = once.repartition(1).sortWithinPartitions("id", "terms")

    def trained(batches: Iterator[pa.RecordBatch]):
        rows, label = [], []
        for batch in batches:
            rows += [np.frombuffer(t, "<i4").astype(np.int64) for t in batch.column("terms").to_pylist()]
            label += batch.column("label").to_pylist()
        yield {"model": [pickle.dumps(train(rows, np.array(label, float)))]}

    model = map_arrow(gathered, "model binary", trained).first()
    return pickle.loads(model[0]) if model else train([], np.zeros(0))


class _Positions(dict):
    """Word to its term's position in the model, or -1."""

    def __init__(self, terms: np.ndarray) -> None:
        super().__init__()
        self._of = {int(t): k for k, t in enumerate(terms)}

    def __missing__(self, word: bytes) -> int:
        place = self._of.get(_term(word), -1)
        if len(word) <= LONG_WORD:
            self[word] = place
        return place


def score(docs: DataFrame, model: FactorizationMachine, held_out: tuple[int, int] = (3, 1), threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_column).alias("id"), F.expr(held_out_column(id_column, *held_out)).alias("held_out"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        fm = shared.value
        places = _Positions(fm.terms)
        for batch in batches:
            if len(places) > _MEMO_WORDS:
                places = _Positions(fm.terms)
            found = [np.array([p for p in {places[w] for w in t.encode().lower().split()} if p >= 0], np.int64) for t in batch.column("text").to_pylist()]
            scores = fm.score(found)
            yield {"id": batch.column("id"), "held_out": batch.column("held_out"), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    schema = f"id {dict(source.dtypes)['id']}, held_out boolean, score double, predicted int"
    return map_arrow(source, schema, rows).withColumnRenamed("id", id_column)


def without_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        places = _Positions(fm.terms)
        for batch in batches:
            if len(places) > _MEMO_WORDS:
                places = _Positions(fm.terms)
            texts = batch.column(batch.schema.names.index(text_column)).to_pylist()
            found = [np.array([p for p in {places[w] for w in (t or "").encode().lower().split()} if p >= 0], np.int64) for t in texts]
            yield batch.filter(pa.array(fm.score(found) < threshold))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
