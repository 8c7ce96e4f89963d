"""LM scoring: whole-document log-probabilities under a gated recurrent model, beside a unigram base.

Words are counted over all training documents. The ``shortlist`` most frequent are
units of the recurrent model; every other word belongs to one of ``TAILS`` tail
units, by its last two bytes, and its probability is the tail unit's times its own
smoothed share of the tail's counts, so the model covers every word. Rare words'
counts are joined to the documents that hold them; only ``HOT_WORDS`` frequent
words of ``HOT_LENGTH`` bytes at most and the model, both of bounded size, are broadcast.

The model is fitted on all training documents, once each at every size: they are
dealt to as many replicas as they fill, and to rounds; each round every replica
trains on its own part and the replicas are averaged by their tokens, in a tree that leaves one row. What counting gathers and what training reads grow with the corpus.
Scoring feeds each whole text, the state carried from window to window.

Defined cases: a null or empty text is the end token alone; a null id is held out;
repeated rows are scored each (and count each, if not held out); without training
documents every score is that of one unknown unit per token; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.llm import gru
from hoplattice.llm.common import held_out_column, map_arrow, stored

HOT_WORDS = 131_072
#: Bytes of the longest word that is collected and broadcast.
HOT_LENGTH = 64
#: Models that are averaged in one step.
FAN = 32
SHORTLIST = 1_960
TAILS = 64
#: Training tokens of one replica.
REPLICA_TOKENS = 6_000_000
_END = b""  # no word is empty
_FLUSH = 600_000  # distinct words that a counting task holds
_ROWS = 64
_SCORED = 3_000_000  # tokens that are scored side by side


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _source(docs: DataFrame, held_out: tuple[int, int], id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("id"), F.expr(held_out_column(id_column, *held_out)).alias("held_out"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )


def word_counts(training: DataFrame) -> DataFrame:
    """``(word binary, count)`` over all rows of ``text``; the end token is the empty word. Pre-aggregated in each task."""

    def rows(batches: Iterator[pa.RecordBatch]):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(_words(text))
                counts[_END] += 1
            if len(counts) > _FLUSH:
                yield {"word": list(counts.keys()), "count": list(counts.values())}
                counts = Counter()
        yield {"word": list(counts.keys()), "count": list(counts.values())}

    return map_arrow(training.select("text"), "word binary, count long", rows).groupBy("word").agg(F.sum("count").alias("count"))


@dataclass
class Statistics:
    """Totals of the training corpus, the hot words, and the units of the model."""

    tokens: int
    distinct: int
    hot: dict[bytes, int]
    unit_of: dict[bytes, int]
    tail_unit: list[int]
    unit_counts: np.ndarray
    tail_base: np.ndarray  # log10(N_b + V_b + 1) of each tail

    @property
    def end(self) -> int:
        return self.unit_of[_END]


def statistics(counts: DataFrame, hot_words: int = HOT_WORDS, shortlist: int = SHORTLIST) -> Statistics:
    """Whole-corpus totals by tail, and the ``hot_words`` most frequent words, the only ones that leave Spark.

    Words of over ``HOT_LENGTH`` bytes never do, however frequent: what is collected and broadcast is bounded in bytes.
    """
    tail = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS))
    totals = counts.where(F.col("word") != F.lit(_END)).groupBy(tail.alias("tail")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in totals:
        n[r["tail"]], v[r["tail"]] = r["n"], r["v"]
    # the least count of a hot word, from the numbers of words by count, so that just the hot words are collected
    short_words = counts.where(F.octet_length("word") <= HOT_LENGTH)
    by_count = short_words.groupBy("count").agg(F.count("*").alias("words")).orderBy(F.desc("count")).withColumnRenamed("count", "c")
    total, least = 0, 1
    for r in by_count.toLocalIterator():
        total += r["words"]
        if total > hot_words:
            least = r["c"] + 1
            break
    hot = sorted(((bytes(r["word"]), r["count"]) for r in short_words.where(F.col("count") >= least).collect()), key=lambda h: (-h[1], h[0]))
    hot_counts = dict(hot)
    ends = hot_counts.setdefault(_END, 0)
    tokens, distinct = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    short = [w for w, _ in hot if w != _END][:shortlist]
    for w in short:
        n[zlib.crc32(w[-2:]) % TAILS] -= hot_counts[w]
        v[zlib.crc32(w[-2:]) % TAILS] -= 1
    units = [(ends, 0, _END)] + [(hot_counts[w], 1, w) for w in short] + [(int(n[b]), 2, b) for b in range(TAILS)]
    units.sort(key=lambda u: -u[0])
    tail_unit = [0] * TAILS
    unit_of = {}
    for k, (_, kind, name) in enumerate(units):
        if kind == 2:
            tail_unit[name] = k
        else:
            unit_of[name] = k
    return Statistics(tokens, distinct, hot_counts, unit_of, tail_unit, np.array([u[0] for u in units], float), np.log10(n + v + 1))


class _Places(dict):
    """Hot word to its row in the statistics' order, or -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


def encode(source: DataFrame, stats: Statistics) -> DataFrame:
    """The rows of ``source`` (with ``text``) as units, in one pass; ``row`` numbers them.

    ``units`` holds 16-bit units, ``hot_known`` and ``hot_log`` the hot words' part of
    the base (their number and sum of logarithms), ``beyond`` what the words add to
    their units' probability, and ``rare`` the words that are not hot, whose counts
    are still to be joined.
    """
    shared = source.sparkSession.sparkContext.broadcast(stats)

    def rows(batches: Iterator[pa.RecordBatch]):
        s = shared.value
        # one row per hot word, and a last one for all others: logarithm of its count, unit, and what it adds beyond its unit
        place = _Places((w, k) for k, w in enumerate(s.hot))
        log_count = np.append(np.log10(np.array(list(s.hot.values()), float) + 1), 0.0)
        tail = np.array([zlib.crc32(w[-2:]) % TAILS for w in s.hot], np.int64)
        short = np.array([w in s.unit_of for w in s.hot], bool)
        unit = np.array([s.unit_of.get(w, s.tail_unit[t]) for w, t in zip(s.hot, tail, strict=True)] + [0], np.uint16)
        beyond = np.append(np.where(short, 0.0, log_count[:-1] - s.tail_base[tail]), 0.0)
        tail_unit = np.array(s.tail_unit, np.uint16)
        end_known, end_log = int(s.hot[_END] > 0), float(log_count[place[_END]])
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), _ROWS):
                per_text = [_words(t) for t in texts[k : k + _ROWS]]
                length = np.array([len(w) for w in per_text], np.int64)
                flat = [w for words in per_text for w in words]
                at = np.array(list(map(place.__getitem__, flat)), np.int64)
                owner = np.repeat(np.arange(len(per_text)), length)
                cold = np.flatnonzero(at < 0)
                rare = [flat[j] for j in cold.tolist()]
                rare_tail = np.array([zlib.crc32(w[-2:]) % TAILS for w in rare], np.int64)
                units = unit[at]
                units[cold] = tail_unit[rare_tail]
                total = lambda weights, own=owner, n=len(per_text): np.bincount(own, weights=weights, minlength=n)
                n_cold = np.bincount(owner[cold], minlength=len(per_text))
                ends, cold_ends = np.cumsum(length), np.cumsum(n_cold)
                own_rare = [rare[b - n : b] for b, n in zip(cold_ends.tolist(), n_cold.tolist(), strict=True)]
                yield {name: batch.column(name).slice(k, _ROWS) for name in kept} | {
                    "row": np.arange(number, number + len(per_text)), "n_tokens": length + 1,
                    "hot_known": length - n_cold + end_known, "hot_log": total(log_count[at]) + end_log,
                    "beyond": total(beyond[at]) - np.bincount(owner[cold], weights=s.tail_base[rare_tail], minlength=len(per_text)),
                    "rare": own_rare, "units": [units[b - n : b].tobytes() for b, n in zip(ends.tolist(), length.tolist(), strict=True)],
                }
                number += len(per_text)

    kept = [c for c in source.columns if c != "text"]
    kinds = dict(source.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in kept) + "row long, n_tokens long, hot_known long, hot_log double, beyond double, rare array<binary>, units binary"
    return map_arrow(source, schema, rows)


def dealt(encoded: DataFrame, replicas: int, rounds: int) -> DataFrame:
    """``(round, replica, row, units)``: every row once. Replicas are keys, so their number doesn't depend on how partitions are set."""
    part = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    return encoded.select(part(2, rounds).alias("round"), part(3, replicas).alias("replica"), "row", "units")


def averaged(models: DataFrame, replicas: int, fan: int = FAN) -> DataFrame:
    """One row from ``models`` (``replica`` below ``replicas``, ``tokens``, ``flat``): their average by tokens, ``fan`` at a time."""

    def mean(key, table):
        weight = np.array(table.column("tokens").to_pylist(), float)
        flat = sum(w * np.frombuffer(f, "<f4").astype(float) for w, f in zip(weight, table.column("flat").to_pylist(), strict=True)) / weight.sum()
        return pa.table({"replica": [key[0].as_py()], "tokens": [int(weight.sum())], "flat": [flat.astype("<f4").tobytes()]}, table.schema)

    while replicas > 1:
        grouped = models.withColumn("replica", F.floor(F.col("replica") / fan).cast("int"))
        models, replicas = grouped.groupBy("replica").applyInArrow(mean, models.schema), -(-replicas // fan)
    return models


def fit(encoded: DataFrame, stats: Statistics, rounds: int = 3, hidden: int = 16) -> gru.Model:
    """Average of replicas, trained side by side in ``rounds`` rounds that share out all rows of ``encoded``."""
    model = gru.Model.fresh(stats.unit_counts, stats.end, hidden)
    if not stats.tokens:
        return model
    replicas = max(1, round(stats.tokens / REPLICA_TOKENS))
    spark = encoded.sparkSession
    parts = dealt(encoded, replicas, rounds)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = parts.where(F.col("round") == k).repartition(replicas, "replica").sortWithinPartitions("replica", "row").select("replica", "units")
        pace = 0.02 * 0.6**k

        def trained(batches: Iterator[pa.RecordBatch], shared=shared, k=k, pace=pace):
            replica, rows = None, []

            def done():
                flat = gru.train(shared.value, rows, rate=pace, seed=k).flat()
                return {"replica": [replica], "tokens": [sum(len(r) + 1 for r in rows)], "flat": [flat.astype("<f4").tobytes()]}

            for batch in batches:
                for own, units in zip(batch.column("replica").to_pylist(), batch.column("units").to_pylist(), strict=True):
                    if own != replica and rows:
                        yield done()
                        rows = []
                    replica = own
                    rows.append(np.frombuffer(units, "<u2"))
            if rows:
                yield done()

        # replicas meet in groups, and groups in groups, until one row is left: what the driver gets is one model at any size
        schema = "replica int, tokens long, flat binary"
        models = averaged(map_arrow(part, schema, trained), replicas).collect()
        if models:
            model = model.with_flat(np.frombuffer(models[0]["flat"], "<f4").astype(float))
    return model


def model_scores(encoded: DataFrame, model: gru.Model, columns: list[str]) -> DataFrame:
    """``columns`` of every row and ``model``: the log10 probability of its units, its end included."""
    shared = encoded.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def rows(batches: Iterator[pa.RecordBatch]):
        net = pickle.loads(shared.value)
        waiting: list[pa.RecordBatch] = []
        units: list[np.ndarray] = []
        size = 0

        def done():
            table = pa.Table.from_batches(waiting).select(columns).combine_chunks()
            return {c: table.column(c) for c in columns} | {"model": gru.score(net, units) / math.log(10)}

        for batch in batches:
            waiting.append(batch)
            units += [np.frombuffer(u, "<u2") for u in batch.column("units").to_pylist()]
            size = sum(len(u) + 1 for u in units)
            if size > _SCORED:
                yield done()
                waiting, units = [], []
        if units:
            yield done()

    kinds = dict(encoded.dtypes)
    return map_arrow(encoded.select(*columns, "units"), ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", model double", rows)


def score(docs: DataFrame, held_out: tuple[int, int] = (7, 2), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    source = _source(docs, held_out, id_column, text_column)
    counts = stored(word_counts(source.where("not held_out")), "lm-counts")
    stats = statistics(counts)
    encoded = stored(encode(source, stats), "lm-encoded")
    model = fit(encoded.where("not held_out"), stats)
    scored = model_scores(encoded, model, ["row", "id", "held_out", "n_tokens", "hot_known", "hot_log", "beyond"])
    rare = encoded.select("row", F.explode("rare").alias("word"))
    # log10(0 + 1) is 0: rare words that training lacks need no row
    known = rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("count") + 1)).alias("rare_log"))
    joined = scored.join(known, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    per_token = math.log10(stats.tokens + stats.distinct + 1)
    return joined.select(
        F.col("id").alias(id_column), "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(stats.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_log") + rare_log - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("model") + F.col("beyond") + rare_log).alias("score"),
    )
