"""Embedding whitening: one streaming pass for the moments, an eigen-solve of one matrix, one pass for the rows.

Entries become integers, so counts and sums are exact and every centred difference n*x - S is rounded once. The moments of a partition are Welford's: row
i adds the rank-one update w d d' with d its distance to the mean of the rows before and w = (i - 1) / i; the updates of a batch are added
by one matrix product. Partitions are merged by the parallel update formula, in two levels of tasks, so the driver gets a single matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, small_batches

SCALE, SHIFT = 1024, 100_000
MERGERS = 32
_STATE = "n bigint, sums array<string>, scatter binary"
_EXACT = 1 << 62


class Moments:
    """Count, exact sums and the scatter matrix (sum of centred outer products) of integer or real rows."""

    def __init__(self, dims: int, whole: bool = True):
        self.n, self.sums, self.scatter, self.whole = 0, [0] * dims if whole else np.zeros(dims), np.zeros((dims, dims)), whole

    def add(self, x: np.ndarray) -> None:
        """Rows one after another, each against the mean of those before it."""
        k = len(x)
        if not k:
            return
        counts = self.n + np.arange(1, k + 1)
        if self.whole:
            wide = x.dtype == object or (int(np.abs(x).max(initial=0)) + 1) * int(counts[-1]) >= _EXACT or max(map(abs, self.sums), default=0) >= _EXACT
            x = x.astype(object) if wide else x
            sums = np.array(self.sums, object if wide else np.int64) + np.cumsum(x, axis=0)
            before = (counts - 1).astype(x.dtype)[:, None]
            moved = x * before - (sums - x)
            self.sums = [int(s) for s in sums[-1]]
        else:
            sums = self.sums + np.cumsum(x, axis=0)
            before = (counts - 1).astype(float)[:, None]
            moved = x * before - (sums - x)
            self.sums = sums[-1]
        moved = moved.astype(float) / np.maximum(before.astype(float), 1.0)
        self.scatter += (moved * ((counts - 1) / counts)[:, None]).T @ moved
        self.n = int(counts[-1])

    def merge(self, other: "Moments") -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.scatter = other.n, other.sums, other.scatter.copy()
            return
        n, m = self.n, other.n
        moved = np.array([float(b * n - a * m) / n / m for a, b in zip(self.sums, other.sums)])
        self.scatter += other.scatter + np.outer(moved, moved) * (n / (n + m) * m)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)] if self.whole else self.sums + other.sums
        self.n = n + m

    def row(self) -> pa.RecordBatch:
        said = [str(s) for s in self.sums] if self.whole else [float(s).hex() for s in self.sums]
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), pa.array([said], pa.list_(pa.string())), pa.array([self.scatter.tobytes()], pa.binary())], ["n", "sums", "scatter"])

    @classmethod
    def of(cls, n: int, sums: list[str], scatter: bytes, whole: bool) -> "Moments":
        out = cls(0, whole)
        out.n, out.sums = n, [int(s) for s in sums] if whole else np.array([float.fromhex(s) for s in sums])
        out.scatter = np.frombuffer(scatter, float).reshape(len(sums), len(sums))
        return out


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector array<double>) of the rows that take part: no null vector, no null or non-finite entry (an entry that isn't finite once
    scaled counts as such), no entries missing: vectors of another length than the most frequent one (the longest among equals) go."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    big = F.lit(1.7976931348623157e308 / SCALE)
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= big), F.lit(False))))
    length = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.where(F.size("vector") == (length["dims"] if length else 0))


def integers(column_: pa.Array) -> np.ndarray:
    """floor(1024 c) + 100000 for each entry, one row each; Python integers where 64 bits could be too few."""
    flat = np.asarray(column_.flatten())
    x = np.floor(flat.reshape(len(column_), -1) * SCALE)
    if np.abs(x).max(initial=0) < 1 << 52:
        return x.astype(np.int64) + SHIFT
    return np.array([[int(v) + SHIFT for v in row] for row in x], object)


def _merged(states: DataFrame, whole: bool) -> Moments | None:
    """All partial moments in one: MERGERS tasks merge those of the scan's tasks one by one, a last task merges theirs."""

    def merge(batches):
        total = None
        for batch in batches:
            for r in batch.to_pylist():
                part = Moments.of(r["n"], r["sums"], r["scatter"], whole)
                if total is None:
                    total = Moments(len(part.sums), whole)
                total.merge(part)
        if total:
            yield total.row()

    spread = states.withColumn("k", F.xxhash64("sums", "n")).repartition(MERGERS, "k").drop("k").mapInArrow(released(merge), _STATE)
    last = spread.repartition(1).mapInArrow(released(merge), _STATE).collect()  # one row at most
    return Moments.of(last[0]["n"], last[0]["sums"], bytes(last[0]["scatter"]), whole) if last else None


@dataclass(frozen=True)
class Whitening:
    """The fit: n rows, their exact sums, eigenvalues (falling) and unit eigenvectors (rows) of the leading components, the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of `vectors`' rows; None where there are none."""
    small_batches(rows.sparkSession)

    def moments(batches):
        total = None
        for batch in batches:
            x = integers(batch.column(0))
            if len(x):
                total = total or Moments(x.shape[1])
                total.add(x)
        if total:
            yield total.row()

    total = _merged(rows.select("vector").mapInArrow(released(moments), _STATE), True)
    if total is None:
        return None
    covariance = total.scatter / total.n
    values, vectors_ = symmetric_qr((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(total.n, tuple(total.sums), np.maximum(values[order], 0.0), vectors_[:, order].T.copy(), float(np.trace(covariance)))


def _negligible(a: np.ndarray) -> float:
    """What is nothing beside the matrix's entries, even squared: smaller numbers would only lose digits to underflow."""
    return float(np.finfo(float).eps ** 2 * np.abs(a).max(initial=0.0))


def _reflected(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) of the tridiagonal Q' a Q, by Householder reflections."""
    a, n = a.copy(), len(a)
    q, least = np.eye(n), _negligible(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size <= least:
            a[k + 1 :, k] = a[k, k + 1 :] = 0.0
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        part = a[k + 1 :, k:]
        part -= 2 * np.outer(v, v @ part)
        part = a[k:, k + 1 :]
        part -= 2 * np.outer(part @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix: a tridiagonal form, then QR steps with Wilkinson's shift, each a chase of
    plane rotations down the matrix, until no off-diagonal entry counts."""
    n = len(a)
    d, e, q = _reflected(np.asarray(a, float))
    q = q.T.copy()  # rows are rotated, as those lie together
    small, least = np.finfo(float).eps, _negligible(a)
    hi = n - 1
    for _ in range(60 * max(n, 1)):
        while hi > 0 and abs(e[hi - 1]) <= small * (abs(d[hi - 1]) + abs(d[hi])) + least:
            e[hi - 1] = 0.0
            hi -= 1
        if hi <= 0:
            break
        lo = hi - 1
        while lo > 0 and abs(e[lo - 1]) > small * (abs(d[lo - 1]) + abs(d[lo])) + least:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + (np.hypot(half, e[hi - 1]) if half >= 0 else -np.hypot(half, e[hi - 1])))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a1, b1, a2 = d[k], e[k], d[k + 1]
            d[k] = c * c * a1 + 2 * c * s * b1 + s * s * a2
            d[k + 1] = s * s * a1 - 2 * c * s * b1 + c * c * a2
            e[k] = c * s * (a2 - a1) + (c * c - s * s) * b1
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    else:
        raise ArithmeticError("the eigen-solve did not settle")
    return d, q.T


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list]:
    """(x - S/n as doubles, sums of (n x - S)^2 as exact integers) for integer rows."""
    bound = (int(np.abs(x).max(initial=0)) + 1) * model.n
    wide = x.dtype == object or bound >= _EXACT or max(map(abs, model.sums), default=0) >= _EXACT
    moved = (x.astype(object) if wide else x) * model.n - np.array(model.sums, object if wide else np.int64)
    most = int(np.abs(moved).max(initial=0))
    if wide or (most >> 24) ** 2 * x.shape[1] >= _EXACT:
        exact = [int(v) for v in (moved.astype(object) ** 2).sum(axis=1)]
    else:  # two halves, whose products fit in 64 bits
        high, low = moved >> 24, moved & 0xFFFFFF
        parts = [(high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)]
        exact = [(int(a) << 48) + (int(b) << 25) + int(c) for a, b, c in zip(*parts)]
    return moved.astype(float) / model.n, exact


def _divisors(model: Whitening) -> np.ndarray:
    """Square roots of the eigenvalues; nan where a component has no variance beyond rounding."""
    floor = len(model.sums) * np.finfo(float).eps * max(model.values.max(initial=0.0), 0.0)
    return np.sqrt(np.where(model.values > floor, model.values, np.nan))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(key, deviation decimal(38,0), whitened array<double>) of `vectors`' rows: the centred row on each component over the root of its
    eigenvalue (null for one without variance), and the exact sum of (n x - S)^2 over its dimensions (null beyond 38 digits)."""
    schema = f"key {rows.schema['key'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    by = _divisors(model)
    small_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            moved, exact = _centred(integers(batch.column(1)), model)
            out = (moved @ model.vectors.T) / by
            flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), flat)
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["key", "deviation", "whitened"])

    return rows.mapInArrow(released(run), schema)


def identity_error(whitened: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of `transform`'s rows minus the identity, over components with variance."""

    def moments(batches):
        total = None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                x = x[:, ~np.isnan(x[0])]
                total = total or Moments(x.shape[1], False)
                total.add(x)
        if total:
            yield total.row()

    total = _merged(whitened.select("whitened").mapInArrow(released(moments), _STATE), False)
    if total is None or not len(total.sums):
        return None
    return float(np.abs(total.scatter / total.n - np.eye(len(total.sums))).max())


_EMPTY = "key bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per row that takes part (`vectors` says which) and component.

    x = floor(1024 c) + 100000 for each entry c. Components are numbered from 1 by falling eigenvalue; each eigenvector's sign is what the solve
    gave, the same for all rows. explained is the eigenvalue's share of the trace; identity_error is measured on the whitened rows in a pass of its own.
    Vectors of fewer dimensions than `components` have as many components as dimensions. A component without variance (constant data, fewer
    rows than dimensions) has null in whitened, 0 in explained and no part in identity_error, which is null where none has any.
    Null keys and repeated rows are rows like others; a table without rows that take part gives an empty result; other columns are ignored.
    """
    rows = vectors(df, key, vector)
    model = fit(rows, components)
    if model is None:
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], _EMPTY.replace("key bigint", f"key {kind}")).withColumnRenamed("key", key)
    out = transform(rows, model)
    error = identity_error(out)
    shares = [float(v) / model.trace if model.trace > 0 and by == by else 0.0 for v, by in zip(model.values, _divisors(model))]
    explained = F.get(F.array(*map(F.lit, shares)), F.col("component") - 1)
    return out.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened"
    ).withColumn("explained", explained).withColumn("identity_error", F.lit(error).cast("double"))
