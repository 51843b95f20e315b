"""Whitened embeddings: exact integer sums, centred outer products, a symmetric eigenvalue decomposition, and a projection that every task has.

An entry c becomes the integer x = floor(256 * c). The fit list is each distinct x vector once. Over it, a first pass sums the entries exactly, which
gives the mean; a second one centres the vectors and sums their outer products, a matrix product for each batch and one matrix for each task, and treeAggregate adds
those, so that the driver gets a few; a third one sums the outer products of the whitened vectors, to tell how far they are from the identity.

Vectors of different lengths are spaces of their own, each with its fit list and components. A null vector and one with a null, NaN or infinite entry have no row. A vector of
length 0 has no components. Entries beyond 64-bit integers are taken as the nearest of these. A component without variance, as that of a single vector, has null
in `whitened` and 0 in `explained`; it does not count for `identity_error`, which is null if there is no other. `deviation` is null where it is above the largest long.
Repeated rows and null ids are rows like others; extra columns are ignored, whatever their names; an empty table gives an empty result.
The driver and each task hold a few matrices of the vectors' length squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, by_arrow, materialize

SCALE = 256
COMPONENTS = 4
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_KINDS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
_LONGS = 1 << 64


@dataclass(frozen=True)
class Fit:
    """Of the vectors of one length: n, exact sums, variances by falling size, and the axes, one column each, over the roots of their variances."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    error: float | None = None


def scaled(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows that have such vectors, and their integers as a matrix. vectors: of lists of doubles."""
    offsets = np.asarray(vectors.offsets)
    values = vectors.values
    flat = values.to_numpy(zero_copy_only=False).astype(float)
    good = np.isfinite(flat) & ~np.asarray(values.is_null())
    bad = np.concatenate([[0], np.cumsum(~good)])
    lengths = np.diff(offsets)
    usable = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~np.asarray(vectors.is_null())
    for length in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == length))
        with np.errstate(over="ignore"):
            x = np.floor(flat[offsets[rows][:, None] + np.arange(length)] * SCALE)
        out = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        out[x >= 2.0**63] = _HIGH
        yield rows, out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's integers in the smallest type that has them all; equal rows have equal bytes."""
    low, high = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x)),) * 2
    kind = sum(((low < np.iinfo(k).min) | (high > np.iinfo(k).max)).astype(int) for k in _KINDS[:2]) + np.zeros(len(x), int)
    out = [b""] * len(x)
    for k in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == k)
        small = x[rows].astype(_KINDS[k])
        for row, values in zip(rows.tolist(), small):
            out[row] = bytes([k]) + values.tobytes()
    return out


def unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    """Matrices of the vectors of each length and type."""
    kinds: dict[tuple[int, int], list[bytes]] = {}
    for v in column.to_pylist():
        kinds.setdefault((v[0], len(v)), []).append(v[1:])
    for (k, _), rows in kinds.items():
        yield np.frombuffer(b"".join(rows), _KINDS[k]).reshape(len(rows), -1).astype(np.int64)


def _merged(partials: DataFrame, kinds: dict[str, type], exact: bool = False) -> dict[int, dict[str, np.ndarray]]:
    """By length, the sums of what tasks give: a row of length and packed arrays for each, added up by treeAggregate."""

    def add(total: dict, row) -> dict:
        return merge(total, {row["length"]: {c: np.frombuffer(row[c], kind).astype(object if exact else kind) for c, kind in kinds.items()}})

    def merge(a: dict, b: dict) -> dict:
        for length, arrays in b.items():
            a[length] = {c: a[length][c] + v for c, v in arrays.items()} if length in a else arrays
        return a

    return partials.rdd.treeAggregate({}, add, merge)


def _summed(fit: DataFrame, of: dict[str, type], sums) -> DataFrame:
    """A row for each task and length: what `sums` makes of the vectors (a tuple of arrays), added over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for x in unpacked(b.column("x")):
                new, length = sums(x), x.shape[1]
                totals[length] = [a + z for a, z in zip(totals[length], new)] if length in totals else list(new)
        for length, arrays in totals.items():
            columns = {c: pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary()) for (c, kind), a in zip(of.items(), arrays)}
            yield batch(length=pa.array([length], pa.int64()), **columns)

    return fit.mapInArrow(run, "length long, " + ", ".join(f"{c} binary" for c in of))


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Of a frame with one column x of packed vectors, each once: a Fit for each length."""
    halves = lambda x: (np.array([len(x)]), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))
    long = {"n": np.int64, "high": np.int64, "low": np.int64}
    sums = {length: (int(s["n"][0]), [(int(h) << 32) + int(lo) for h, lo in zip(s["high"], s["low"])]) for length, s in _merged(_summed(vectors, long, halves), long, exact=True).items()}
    mean = {length: np.array([s / n for s in total], float) for length, (n, total) in sums.items()}

    def products(x: np.ndarray) -> tuple[np.ndarray]:
        centred = x - mean[x.shape[1]]
        return (centred.T @ centred,)

    out = {}
    for length, s in _merged(_summed(vectors, {"outer": np.float64}, products), {"outer": np.float64}).items():
        n, total = sums[length]
        variance = s["outer"].reshape(length, length) / n
        values, axes = np.linalg.eigh(variance)
        values, axes = values[::-1], axes[:, ::-1]
        k = min(components, length)
        whole = float(np.trace(variance))
        real = values[:k] > (length * np.finfo(float).eps * values[0] if length else 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(real, axes[:, :k] / np.sqrt(values[:k]), np.nan)
        out[length] = Fit(n, total, mean[length], scale, np.where(real, values[:k] / whole if whole else 0.0, 0.0))
    return out


def with_errors(fits: dict[int, Fit], vectors: DataFrame) -> dict[int, Fit]:
    """The same with the largest entry of the whitened vectors' covariance minus the identity."""

    def products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = fits[x.shape[1]]
        w = (x - fit.mean) @ fit.axes
        return w.sum(0), w.T @ w

    kinds = {"total": np.float64, "outer": np.float64}
    out = dict(fits)
    for length, s in _merged(_summed(vectors, kinds, products), kinds).items():
        fit, k = fits[length], len(fits[length].explained)
        mean = s["total"] / fit.n
        error = np.abs(s["outer"].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k))
        known = error[~np.isnan(error)]
        out[length] = Fit(fit.n, fit.sums, fit.mean, fit.axes, fit.explained, float(known.max()) if len(known) else None)
    return out


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """The exact sum of (n * x - S)^2 for each vector, or null if it is no long."""
    about = ((x - fit.mean) ** 2).sum(1) * float(fit.n) ** 2
    # where the true value is a long, so are its parts, and wrapping sums end at them
    sums = np.array([s % _LONGS for s in fit.sums], np.uint64)
    d = np.uint64(fit.n % _LONGS) * x.astype(np.uint64) - sums
    out = (d * d).sum(1).astype(object)
    for k in np.flatnonzero(about > 2.0**61).tolist():
        exact = sum((fit.n * v - s) ** 2 for v, s in zip(x[k].tolist(), fit.sums)) if about[k] < 2.0**66 else _LONGS
        out[k] = exact if exact <= _HIGH else None
    return out.tolist()


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained, identity_error: for each row with a vector, and each of its first components."""
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    pack = lambda b: (batch(x=pa.array(packed(x), pa.binary())) for _, x in scaled(b.column("v")))
    vectors = materialize(by_arrow(base.select("v"), pack, "x binary").distinct())
    fits = rows.sparkSession.sparkContext.broadcast(with_errors(fitted(vectors, components), vectors))

    def project(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, x in scaled(b.column("v")):
            fit = fits.value.get(x.shape[1])
            k = len(fit.explained) if fit else 0
            if not k:
                continue
            w = ((x - fit.mean) @ fit.axes).ravel()
            many = len(at)
            yield batch(
                id=b.column("id").take(pa.array(np.repeat(at, k))), component=pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), n=pa.array(np.full(many * k, fit.n)),
                deviation=pa.array([d for d in deviations(x, fit) for _ in range(k)], pa.int64()), whitened=pa.array(w, mask=np.isnan(w)),
                explained=pa.array(np.tile(fit.explained, many)), identity_error=pa.array([fit.error] * (many * k), pa.float64()),
            )

    kind = base.schema["id"].dataType.simpleString()
    found = by_arrow(base, project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return found.withColumnRenamed("id", id_col)
