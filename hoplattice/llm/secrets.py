"""Secret scans: rule matches, and a character convolutional network over every candidate.

Candidates are runs of ``[A-Za-z0-9+/_=-]`` of 12 characters or more with a digit.
The network sees a candidate with 24 characters on either side (a long candidate
in several windows, of which the highest counts): character embeddings, one
convolution, the maximum over places, one output. It is trained on labelled
findings: candidates that a rule finds are positive, all others negative. Every
distinct window of all documents counts once, whatever their number: those learned
from are dealt by hash to shards of about ``shard_windows``, and each round trains
one copy of the network a shard and averages the copies. A label with few windows a
shard has each in several shards, weighing as much less, so no copy misses rare findings.
Half of the positives are shown without their context too, so that the key's own
look counts. Scores are calibrated on all windows of a fifth of the documents (Platt;
where that leaves a part without positives they are divided by hash, and a lone
one serves both parts), and the threshold is the highest that keeps ``recall`` of the
calibration's positives. Candidates at or
above it which no rule covers are added as kind ``cnn``; rule matches always stay.

Defined cases: a null or empty text has no spans, and the digest of the empty
string; without positives in the whole table nothing is added; rule matches of different
kinds may overlap; ids may be null and repeat; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.llm.common import bounded_batches, map_arrow, stored
from hoplattice.llm.lm import averaged

KINDS = ("assign", "access", "hex", "cnn")
#: Windows that one task trains on at a time, about; there are as many shards as all windows need.
SHARD_WINDOWS = 16_384
#: Windows of either label that every shard has at least, if there are as many; or this share of a shard, if that is more.
SHARD_LEAST, SHARD_SHARE = 64, 0.25
RECALL = 0.95
EPOCHS = 8
SEED = 3
# The rules' patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{12,}")
_DIGIT = re.compile("[0-9]")
_SIDE, _CORE = 24, 48
_WIDTH = _CORE + 2 * _SIDE
_SPANS = 4_096  # candidates, and windows, that are scored at once


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the rules' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0])]


class _Covered:
    """Tells whether a span overlaps any of the given ones, which are in the order of their starts."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self._starts = [a for a, _, _ in spans]
        self._furthest = list(accumulate((b for _, _, b in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self._starts, end)
        return before > 0 and self._furthest[before - 1] > start


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The candidate's windows as character classes: 0 is padding, 1 any character beyond ASCII."""
    out = []
    for at in range(start, end, _CORE):
        before = text[max(0, at - _SIDE) : at].rjust(_SIDE, "\0")
        rest = text[at : min(end, at + _CORE)].ljust(_CORE, "\0")
        after = text[min(end, at + _CORE) : min(end, at + _CORE) + _SIDE].ljust(_SIDE, "\0")
        out.append(bytes(min(ord(c), 127) if ord(c) < 127 else 1 for c in before + rest + after))
    return out


@dataclass
class CharCNN:
    """Embedding, convolution, maximum over places, logistic output, Platt scaling and threshold."""

    embedding: np.ndarray
    kernel: np.ndarray
    offset: np.ndarray
    output: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.embedding[x]
        width = self.kernel.shape[0]
        stacked = np.concatenate([e[:, k : e.shape[1] - width + 1 + k] for k in range(width)], axis=2)
        return stacked, stacked @ self.kernel.reshape(-1, self.kernel.shape[2]) + self.offset

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self._hidden(x[k : k + 512])[1].max(axis=1), 0) @ self.output + self.bias for k in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the weighted mean log loss by embedding, kernel, offset, output and bias."""
        width, dim, _ = self.kernel.shape
        stacked, hidden = self._hidden(x)
        place = hidden.argmax(axis=1)
        top = np.take_along_axis(hidden, place[:, None, :], axis=1)[:, 0]
        z = np.maximum(top, 0) @ self.output + self.bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / len(x)
        g_top = g[:, None] * self.output * (top > 0)
        n, _, inputs = stacked.shape
        row = np.arange(n)[:, None]
        g_kernel = np.einsum("nf,nfi->if", g_top, stacked[row, place]).reshape(self.kernel.shape)
        g_input = (g_top[:, :, None] * self.kernel.reshape(inputs, -1).T[None]).reshape(n, -1, width, dim)
        g_embedding = np.zeros_like(self.embedding)
        for k in range(width):
            np.add.at(g_embedding, x[row, place + k].ravel(), g_input[:, :, k].reshape(-1, dim))
        return g_embedding, g_kernel, g_top.sum(axis=0), np.maximum(top, 0).T @ g, np.array([g.sum()])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -40, 40)))


def _parts(label: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fitting and of the calibration part.

    ``held`` marks the windows of documents set apart for the calibration. Where it
    leaves a part without positives (or is not given) the positives are divided one
    by one, four fifths and a fifth, and one at least is in both parts.
    """
    fitted, calibration = [], []
    for value in (0, 1):
        own = np.flatnonzero((label > 0) == value)
        apart = np.arange(len(own)) % 5 == 4 if held is None else held[own]
        if value and len(own) and (apart.all() or not apart.any()):
            apart = np.arange(len(own)) % 5 == 4
            apart[-1] = True
        fitted.append(own if len(own) == 1 else own[~apart])
        calibration.append(own[apart])
    return np.sort(np.concatenate(fitted)), np.sort(np.concatenate(calibration))


def _fresh(filters: int = 24, width: int = 5, dim: int = 8, seed: int = SEED) -> CharCNN:
    rng = np.random.default_rng(seed)
    return CharCNN(rng.normal(0, 0.3, (128, dim)), rng.normal(0, 0.2, (width, dim, filters)), np.zeros(filters), rng.normal(0, 0.2, filters), 0.0)


class _Adam:
    """Descent of a network; ``flat`` is all that another task needs to go on from here."""

    def __init__(self, net: CharCNN, flat: np.ndarray | None = None) -> None:
        self.net = net
        self._values = [net.embedding, net.kernel, net.offset, net.output, np.array([net.bias])]
        self._first, self._second = [np.zeros_like(v) for v in self._values], [np.zeros_like(v) for v in self._values]
        self._step = 0.0
        if flat is not None:
            at = 0
            for part in (*self._values, *self._first, *self._second):
                part[...] = flat[at : at + part.size].reshape(part.shape)
                at += part.size
            self._step = float(flat[at])
            net.bias = float(self._values[4][0])

    def flat(self) -> np.ndarray:
        return np.concatenate([*(part.ravel() for part in (*self._values, *self._first, *self._second)), [self._step]])

    def epoch(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            grads = self.net.gradients(x[part], y[part], weight[part])
            self._step += 1
            for value, first, second, grad in zip(self._values, self._first, self._second, grads, strict=True):
                first *= 0.9
                first += 0.1 * grad
                second *= 0.999
                second += 0.001 * grad**2
                value -= 0.005 * first / (1 - 0.9**self._step) / (np.sqrt(second / (1 - 0.999**self._step)) + 1e-8)
            self.net.bias = float(self._values[4][0])


def _positive_weight(negatives: int, positives: int) -> float:
    """Of a positive beside a negative; half of the positives are shown twice."""
    return max(1.0, negatives / max(1, positives + (positives + 1) // 2)) ** 0.5


def _shown(x: np.ndarray, y: np.ndarray, positive: float, negative: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and weights, every other positive once more without its context."""
    masked = x[y > 0][::2].copy()
    masked[:, :_SIDE] = 0
    masked[:, _SIDE + _CORE :] = 0
    x, y = np.concatenate([x, masked]), np.concatenate([y, np.ones(len(masked))])
    return x, y, np.where(y > 0, positive, negative)


def _platt(sums: Callable[[float, float], tuple[float, ...]]) -> tuple[float, float]:
    """Newton's steps for slope and shift, slightly held back; ``sums`` of rz, r, hzz, hz and h at given ones."""
    a, b = 1.0, 0.0
    for _ in range(50):
        rz, r, hzz, hz, h = sums(a, b)
        step = np.linalg.solve(np.array([[hzz + 0.1, hz], [hz, h + 0.1]]), np.array([rz + 0.1 * (a - 1), r + 0.1 * b]))
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def _calibrated(net: CharCNN, platt: tuple[float, float], lowest: float) -> CharCNN:
    """``lowest`` is the output that the threshold lets through."""
    net.slope, net.shift = max(platt[0], 1e-3), platt[1]
    net.threshold = float(1 / (1 + np.exp(-np.clip(net.slope * lowest + net.shift, -40, 40))))
    return net


def train(x: np.ndarray, label: np.ndarray, recall: float = RECALL, epochs: int = EPOCHS, filters: int = 24, width: int = 5, dim: int = 8, seed: int = SEED, held: np.ndarray | None = None) -> CharCNN:
    """Fit by Adam on four fifths of the windows, calibrate and set the threshold on the rest; what ``fit`` does with one shard."""
    net = _fresh(filters, width, dim, seed)
    if not (label > 0).any():
        return net
    fitted, calibration = _parts(label, held)
    positives = int((label[fitted] > 0).sum())
    shown = _shown(x[fitted], label[fitted], _positive_weight(len(fitted) - positives, positives))
    adam = _Adam(net)
    for k in range(epochs):
        adam.epoch(*shown, np.random.default_rng((seed, k, 0)))
    z, y = net.logits(x[calibration]), label[calibration]

    def sums(a: float, b: float) -> tuple[float, ...]:
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, h = p - y, np.maximum(p * (1 - p), 1e-6)
        return (r * z).sum(), r.sum(), (h * z * z).sum(), (h * z).sum(), h.sum()

    positive = np.sort(z[y > 0])
    return _calibrated(net, _platt(sums), float(positive[int(np.floor((1 - recall) * len(positive)))]))


def _rank(window: bytes) -> int:
    return xxhash.xxh64_intdigest(window) >> 1


def _arrays(windows: bytes) -> np.ndarray:
    return np.frombuffer(windows, np.uint8).reshape(-1, _WIDTH).astype(np.int64)


def labelled_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(rank, window, label, held)``: every distinct window of all documents, once.

    A window found with both labels counts as positive; one of several documents is
    held out only if all of them are.
    """
    held = (F.pmod(F.xxhash64(id_column), F.lit(5)) == 4).cast("int")
    texts = docs.where(F.col(text_column).isNotNull()).select(F.col(text_column).alias("text"), held.alias("held"))

    def labelled(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            seen, labels, parts = [], [], []
            for text, held in zip(batch.column("text").to_pylist(), batch.column("held").to_pylist(), strict=True):
                spans = candidates(text)
                known = _Covered(rule_spans(text)) if spans else None
                for span in spans:
                    cut = windows(text, *span)
                    seen += cut
                    labels += [int(known(*span))] * len(cut)
                    parts += [held] * len(cut)
                    if len(seen) >= _SPANS:
                        yield {"rank": [_rank(w) for w in seen], "window": seen, "label": labels, "held": parts}
                        seen, labels, parts = [], [], []
            if seen:
                yield {"rank": [_rank(w) for w in seen], "window": seen, "label": labels, "held": parts}

    found = map_arrow(texts, "rank long, window binary, label int, held int", labelled)
    return found.groupBy("rank", "window").agg(F.max("label").alias("label"), F.min("held").alias("held"))


def parted(found: DataFrame) -> DataFrame:
    """Adds ``fitted`` and ``calibrating``: by document, but positives by hash where a part would have none; a lone window of a label serves both."""
    totals = found.groupBy("label").agg(F.count("*").alias("n"), F.sum("held").alias("held"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    of = {r["label"]: r for r in totals.collect()}
    apart, both = F.col("held") == 1, F.lit(False)
    for label, r in of.items():
        own = F.col("label") == label
        if r["n"] == 1:
            both = both | own
        if label == 1 and r["held"] in (0, r["n"]):
            by_hash = (F.col("rank") != r["low"]) & ((F.pmod("rank", F.lit(5)) == 4) | (F.col("rank") == r["high"]))
            apart = F.when(own, by_hash | F.lit(r["n"] == 1)).otherwise(apart)
    return found.withColumns({"fitted": ~apart | both, "calibrating": apart})


def shards(fitted: DataFrame, shard_windows: int = SHARD_WINDOWS) -> tuple[DataFrame, int, tuple[float, float]]:
    """``(replica, labels, windows)``, a row a shard, their number, and the weights of positives and negatives."""
    n = {r["label"]: r["count"] for r in fitted.groupBy("label").count().collect()}
    number = max(1, -(-sum(n.values()) // shard_windows))
    least = max(SHARD_LEAST, int(SHARD_SHARE * shard_windows))
    copies = {label: min(number, -(-least * number // n[label])) if label in n else 1 for label in (0, 1)}
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1))
    dealt = fitted.select("rank", "window", "label", turn.alias("turn"))
    dealt = dealt.withColumn("replica", F.pmod(F.col("rank") % number + F.col("turn"), F.lit(number)).cast("int"))
    dealt = dealt.repartition(number, "replica").sortWithinPartitions("replica", "rank", "window").select("replica", "label", "window")

    def joined(batches: Iterator[pa.RecordBatch]):
        replica, labels, seen = None, [], []
        for batch in batches:
            for own, label, window in zip(*(batch.column(c).to_pylist() for c in ("replica", "label", "window")), strict=True):
                if own != replica and seen:
                    yield {"replica": [replica], "labels": [bytes(labels)], "windows": [b"".join(seen)]}
                    labels, seen = [], []
                replica = own
                labels.append(label)
                seen.append(window)
        if seen:
            yield {"replica": [replica], "labels": [bytes(labels)], "windows": [b"".join(seen)]}

    weights = _positive_weight(n.get(0, 0), n.get(1, 0)) / copies[1], 1 / copies[0]
    return stored(map_arrow(dealt, "replica int, labels binary, windows binary", joined), "secret-shards"), number, weights


def _descended(parts: DataFrame, number: int, weights: tuple[float, float], epochs: int = EPOCHS) -> CharCNN:
    """Average of the shards' networks, an epoch a round; what the driver gets a round is one network."""
    adam = _Adam(_fresh())
    for k in range(epochs):
        shared = parts.sparkSession.sparkContext.broadcast(adam.flat())

        def trained(batches: Iterator[pa.RecordBatch], shared=shared, k=k):
            for batch in batches:
                for replica, labels, seen in zip(*(batch.column(c).to_pylist() for c in ("replica", "labels", "windows")), strict=True):
                    own = _Adam(_fresh(), shared.value)
                    shown = _shown(_arrays(seen), np.frombuffer(labels, np.uint8).astype(float), *weights)
                    own.epoch(*shown, np.random.default_rng((SEED, k, replica)))
                    yield {"replica": [replica], "tokens": [len(labels)], "flat": [own.flat().astype("<f4").tobytes()]}

        mean = averaged(map_arrow(parts, "replica int, tokens long, flat binary", trained), number).collect()[0]
        adam = _Adam(_fresh(), np.frombuffer(mean["flat"], "<f4").astype(float))
    return adam.net


def _at_place(values: DataFrame, place: int) -> float:
    """The ``z`` at ``place`` in ascending order, by counts in ever narrower bins."""
    low, high = values.agg(F.min("z"), F.max("z")).first()
    while low < high:
        of_bin = values.groupBy(F.width_bucket("z", F.lit(low), F.lit(high), F.lit(1_024)).alias("bin"))
        for r in of_bin.agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).orderBy("bin").collect():
            low, high = r["low"], r["high"]
            if place < r["n"]:
                break
            place -= r["n"]
        values = values.where(F.col("z").between(low, high))
    return low


def _calibration(calibrating: DataFrame, net: CharCNN, recall: float) -> CharCNN:
    """Slope, shift and threshold from all windows of the calibration; sums and counts alone reach the driver."""
    shared = calibrating.sparkSession.sparkContext.broadcast(net)

    def outputs(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield {"label": batch.column("label"), "z": shared.value.logits(_arrays(b"".join(batch.column("window").to_pylist())))}

    z = stored(map_arrow(calibrating.select("label", "window"), "label int, z double", outputs), "secret-outputs")

    def sums(a: float, b: float) -> tuple[float, ...]:
        at = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("z") * a + b))
        with_p = z.withColumn("p", 1 / (1 + F.exp(-at)))
        r, h = F.col("p") - F.col("label"), F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-6))
        return tuple(with_p.agg(*(F.sum(c).alias(f"s{k}") for k, c in enumerate((r * F.col("z"), r, h * F.col("z") * F.col("z"), h * F.col("z"), h)))).first())

    positive = z.where("label = 1")
    return _calibrated(net, _platt(sums), _at_place(positive, int(np.floor((1 - recall) * positive.count()))))


def fit(docs: DataFrame, shard_windows: int = SHARD_WINDOWS, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text", sample_windows: int | None = None) -> CharCNN:
    """Train, calibrate and set the threshold on every distinct window of all documents.

    ``sample_windows`` is the older name of ``shard_windows``.
    """
    found = parted(stored(labelled_windows(docs, id_column, text_column), "secret-windows"))
    if found.where("label = 1").isEmpty():
        return _fresh()
    net = _descended(*shards(found.where("fitted"), sample_windows or shard_windows))
    return _calibration(found.where("calibrating"), net, recall)


def _best_scores(texts: list[str], spans: list[tuple[int, tuple[int, int]]], net: CharCNN) -> Iterator[float]:
    """The highest score of the windows of each ``(text, span)``; windows are made in slices."""
    for k in range(0, len(spans), _SPANS):
        cut = [windows(texts[at], *span) for at, span in spans[k : k + _SPANS]]
        best = np.zeros(len(cut))
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        flat = [w for c in cut for w in c]
        for j in range(0, len(flat), _SPANS):
            part = np.frombuffer(b"".join(flat[j : j + _SPANS]), np.uint8).reshape(-1, _WIDTH)
            np.maximum.at(best, owner[j : j + _SPANS], net.probability(part))
        yield from best


def spans_of(texts: list[str], net: CharCNN) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: the rules' and those that the network adds."""
    out = [rule_spans(t) for t in texts]
    if net.threshold <= 1:
        covered = [_Covered(spans) for spans in out]
        open_spans = [(k, span) for k, t in enumerate(texts) for span in candidates(t) if not covered[k](*span)]
        for (k, (start, end)), p in zip(open_spans, _best_scores(texts, open_spans, net), strict=True):
            if p >= net.threshold:
                out[k].append((start, 3, end))
        for spans in out:
            spans.sort()
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, net: CharCNN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of every row: counts by rule, a digest of the rules' spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = spans_of(batch.column("text").to_pylist(), shared.value)
            base = [[s for s in spans if s[1] < 3] for spans in found]
            yield {"id": batch.column("id")} | {
                f"n_{KINDS[k]}": [sum(s[1] == k for s in spans) for spans in base] for k in range(3)
            } | {"base_sha256": [hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], "spans": [_joined(s) for s in found]}

    schema = f"id {dict(source.dtypes)['id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_arrow(source, schema, rows).withColumnRenamed("id", id_column)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, done = [], 0
    for start, _, end in sorted(spans):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def without_secrets(docs: DataFrame, net: CharCNN, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by a mark, and the length column brought up to date."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text_column)).to_pylist()
            spans = spans_of([t or "" for t in texts], shared.value)
            new = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            batch = batch.set_column(names.index(text_column), batch.schema.field(text_column), pa.array(new, batch.schema.field(text_column).type))
            if length_column in names:
                field = batch.schema.field(length_column)
                old = batch.column(names.index(length_column)).to_pylist()
                length = [len(t) if s else n for t, s, n in zip(new, spans, old, strict=True)]
                batch = batch.set_column(names.index(length_column), field, pa.array(length, field.type))
            yield batch

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
