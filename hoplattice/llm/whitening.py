"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows X (n x p, centred) are stored once, in blocks of small integers. One pass over
the blocks serves one step: given a vector g it returns z = X'(Xg) and |Xg|^2, added up
in Spark to p + 1 numbers. Left vectors are never stored: u_k = X g_k / alpha_k with
g_k = v_k - sum_j (z_j . v_k) h_j over all earlier u_j = X h_j, z_j = X'u_j, so that u_k is orthogonal to
all of them, and v_(k+1) is z_k made orthogonal, twice, to all v: full
reorthogonalisation on both sides, with vectors of p numbers on the driver. X = U B V'
with a bidiagonal B, whose singular vectors turned by V are the components, and whose
squared singular values over n are the eigenvalues.

Steps end after p of them, or earlier once the 32 (``components``) leading directions
have residuals at the level of rounding and what is left of the trace is less than the
least of them, so that none can be missing. Where a direction gives nothing new (equal
eigenvalues, dependent columns) the next starts from a fresh vector orthogonal to the rest.

Entries are taken as ``floor(scale * c) + offset`` of their doubles; sums, and the
deviations (n x - S)^2, are whole numbers and exact.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are
dropped; of several lengths the one with most rows counts (of equal ones the longest) and rows of others are
dropped; an empty vector has no components. Components whose eigenvalue is zero (to rounding: below
p * 2^-50 of the largest) are left out, as nothing can be divided by it: constant vectors and a
table of one row give no rows. Entries beyond 2^52 over ``scale`` count as that.
A deviation beyond a long is null. Ids may be null and repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.llm.common import map_arrow, stored

#: Components that are returned at most.
COMPONENTS = 32
#: Bytes of one block of rows as doubles.
BLOCK_BYTES = 2 << 20
_EPS = float(np.finfo(float).eps)
_FURTHEST = float(1 << 52)


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * c)`` of doubles, as integers; the offset is left off, since it only shifts."""
    return np.floor(np.clip(vectors * scale, -_FURTHEST, _FURTHEST)).astype(np.int64)


def _usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col("vector")
    infinite = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # cast to doubles in Spark, so that any numeric array can be whitened
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(v.isNotNull() & ~infinite)


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), p)


@dataclass
class Whitening:
    """What a table needs to be whitened: n, p, the sums of the whole entries (without offset), components and eigenvalues."""

    n: int
    p: int
    scale: float
    sums: list[int]
    components: np.ndarray  # p x r, orthonormal columns
    eigenvalues: np.ndarray  # r, falling
    trace: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.components) / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; in machine integers only where these can't overflow."""
        most = max((self.n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, self.sums), default=0)), 1)
        if most < 1 << 62 and most * most * max(1, self.p) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]


class Rows:
    """The whole entries in stored blocks, and what a pass over them adds up."""

    def __init__(self, vectors: DataFrame, p: int, scale: float) -> None:
        self.p = p
        per_block = max(1, BLOCK_BYTES // (8 * max(1, p)))

        def blocks(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for k in range(0, batch.num_rows, per_block):
                    x = whole(_matrix(batch.column("vector").slice(k, per_block), p), scale)
                    least = next(t for t in ("int8", "int16", "int32", "int64") if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
                    sums = x.astype(object).sum(axis=0) if least == "int64" else x.sum(axis=0)
                    yield {"rows": [len(x)], "kind": [least], "data": [x.astype(least).tobytes()], "sums": [[str(s) for s in sums]]}

        made = map_arrow(vectors.select("vector"), "rows long, kind string, data binary, sums array<string>", blocks)
        self.blocks = stored(made, "whitening-rows")
        total = self.blocks.select("rows", F.posexplode("sums").alias("dimension", "value"))
        found = total.groupBy("dimension").agg(F.sum("rows").alias("rows"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        self.n = int(found[0]["rows"]) if found else 0
        self.sums = [int(r["value"]) for r in sorted(found, key=lambda r: r["dimension"])]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(p)

    def added(self, value, size: int) -> np.ndarray:
        """The sum over all blocks of ``value(centred rows)``, an array of ``size`` numbers; tasks' sums are added in Spark."""
        mean, p = self.mean, self.p

        def sums(batches: Iterator[pa.RecordBatch]):
            total = np.zeros(size)
            for batch in batches:
                for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                    total += value(np.frombuffer(data.as_buffer(), kind).reshape(-1, p) - mean)
            yield {"place": np.arange(size), "value": total}

        parts = map_arrow(self.blocks.select("kind", "data"), "place int, value double", sums)
        out = np.zeros(size)
        for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
            out[row["place"]] = row["value"]
        return out


def _times(g: np.ndarray):
    def value(x: np.ndarray) -> np.ndarray:
        u = x @ g
        return np.append(x.T @ u, u @ u)

    return value


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):  # twice is enough for full orthogonality in doubles
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(times, p: int, trace: float, components: int = COMPONENTS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """Right singular vectors (columns) and singular values, falling, of the matrix behind ``times``; and the steps taken.

    ``times(g)`` gives X'(Xg) followed by |Xg|^2; ``trace`` is the sum of X's squared entries.
    """
    rng = np.random.default_rng(seed)
    v, found, lifts, images, upper = [], [], [], [], np.zeros((p, p + 1))
    nothing = 8 * p * _EPS * np.sqrt(trace)

    def fresh() -> np.ndarray:
        start = _orthogonal(rng.normal(size=p), v)
        return start / np.linalg.norm(start)

    direction, steps = fresh(), 0
    while True:
        v.append(direction)
        k = len(v) - 1
        # X v_k less its part along all earlier u_j, whose inner products with it are known: u_j.Xv = (X'u_j).v
        g = direction.copy()
        for h, z in zip(lifts, images, strict=True):
            g -= (z @ direction) * h
        out, steps = times(g), steps + 1
        alpha = float(np.sqrt(max(out[p], 0.0)))
        for j, z in enumerate(images):
            upper[found[j], k] = z @ direction
        if alpha > nothing:
            lifts.append(g / alpha)
            images.append(out[:p] / alpha)
            found.append(k)
            upper[k, k] = alpha
            rest = _orthogonal(images[-1], v)
        else:
            rest = np.zeros(p)
        beta = float(np.linalg.norm(rest))
        if k + 1 == p:
            break
        direction = rest / beta if beta > nothing else fresh()
        if beta > nothing and k + 1 >= components:
            left, sigma, _ = np.linalg.svd(upper[: k + 1, : k + 1])
            unseen = trace - float((upper[: k + 1, : k + 1] ** 2).sum())
            wanted = sigma[: min(components, len(sigma))]
            if (beta * np.abs(left[k, : len(wanted)]) <= 4 * _EPS * sigma[0]).all() and unseen < wanted[-1] ** 2:
                break
    size = len(v)
    _, sigma, right = np.linalg.svd(upper[:size, :size])
    return np.array(v).T @ right.T, sigma, steps


def fit(df: DataFrame, components: int = COMPONENTS, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> Whitening | None:
    """Components and eigenvalues of all usable rows; None where there are none."""
    usable = _usable(df, id_column, vector_column)
    lengths = usable.groupBy(F.size("vector").alias("p")).count().orderBy(F.desc("count"), F.desc("p")).first()
    if lengths is None:
        return None
    p = lengths["p"]
    if not p:
        return Whitening(lengths["count"], 0, scale, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    rows = Rows(usable.where(F.size("vector") == p), p, scale)
    trace = float(rows.added(lambda x: np.array([(x * x).sum()]), 1)[0])
    if trace <= 0:
        return Whitening(rows.n, p, scale, rows.sums, np.zeros((p, 0)), np.zeros(0), 0.0, 0)
    vectors, sigma, steps = bidiagonalise(lambda g: rows.added(_times(g), p + 1), p, trace, components)
    values = sigma**2 / rows.n
    kept = min(components, int((values > p * 2.0**-50 * values[0]).sum()))
    return Whitening(rows.n, p, scale, rows.sums, vectors[:, :kept], values[:kept], trace / rows.n, steps)


def identity_error(df: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> float:
    """Measured over all rows: the largest entry of the whitened rows' covariance less the identity."""
    r, p = len(model.eigenvalues), model.p

    def sums(batches: Iterator[pa.RecordBatch]):
        first, second = np.zeros(r), np.zeros((r, r))
        for batch in batches:
            w = model.project(whole(_matrix(batch.column("vector"), p), model.scale))
            first += w.sum(axis=0)
            second += w.T @ w
        yield {"place": np.arange(r + r * r), "value": np.append(first, second)}

    rows = _usable(df, id_column, vector_column).where(F.size("vector") == p).select("vector")
    total = np.zeros(r + r * r)
    for row in map_arrow(rows, "place int, value double", sums).groupBy("place").agg(F.sum("value").alias("value")).collect():
        total[row["place"]] = row["value"]
    mean = total[:r] / model.n
    return float(np.abs(total[r:].reshape(r, r) / model.n - np.outer(mean, mean) - np.eye(r)).max())


def whiten(df: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(id, deviation, whitened)`` of every usable row: the exact deviation and an array, one number for each component."""
    usable = _usable(df, id_column, vector_column)
    kept = usable.where(F.size("vector") == (model.p if model else 0)) if model and len(model.eigenvalues) else usable.limit(0)

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                x = whole(_matrix(batch.column("vector"), model.p), model.scale)
                w = model.project(x)
                flat = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
                yield {"id": batch.column("id"), "deviation": model.deviations(x), "whitened": flat}

    return map_arrow(kept, f"id {dict(kept.dtypes)['id']}, deviation long, whitened array<double>", rows).withColumnRenamed("id", id_column)


def components_table(df: DataFrame, components: int = COMPONENTS, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row for each usable row and component, with n, the share of the trace and the measured error of the identity."""
    model = fit(df, components, scale, id_column, vector_column)
    whitened = whiten(df, model, id_column, vector_column).select(id_column, "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    some = model is not None and len(model.eigenvalues) > 0
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)) if some else F.array(F.lit(0.0))
    return whitened.select(
        id_column,
        (F.col("_place") + 1).cast("int").alias("component"),
        F.lit(model.n if some else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_place")).alias("explained"),
        F.lit(identity_error(df, model, id_column, vector_column) if some else 0.0).alias("identity_error"),
    )
