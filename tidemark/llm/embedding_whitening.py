"""Embedding whitening by one-sided Jacobi rotations on a blockwise QR factor.

A component c becomes the whole number floor(64 c) + 1,000,000. The fit looks at each distinct
vector once: their number n and the sums S are exact, and rows are centred before anything is
multiplied (x - S/n, with a whole base taken off first, so no digits are lost). Every task reduces
its centred rows to a triangle R by QR, block after block; triangles meet by eights, as a tree,
until one of the size of the dimensions is left. Plane rotations make its columns orthogonal, in
rounds of disjoint pairs; their lengths are the standard deviations (times the root of n), the
accumulated rotations the components. Nothing is squared on the way, and columns of any scale keep
their own relative accuracy.

A component exists where its deviation isn't all rounding: more than a few units in the last place
of what its weights and the columns' own lengths would give. So a table of one distinct vector has
none, and a dimension that repeats another adds none. Components go by falling deviation; of the
two signs the one that makes the largest weight positive is taken (first of equal ones).

Bounds: the driver and a task hold a triangle of the dimensions, by each length of vector there is.

Cases: vectors that are null or hold null or non-finite entries take no part, nor do those with an
entry beyond 2**56 in size, whose whole number might leave a long; vectors of different lengths
have fits of their own; empty vectors give no rows; repeated rows count once in the fit and each
give their result; a null id is kept; a deviation beyond a long is null; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

GRID = 64
BASE = 1_000_000
COMPONENTS = 16
#: Largest size of an entry: floor(64 c) + BASE stays within a long.
LARGEST = float(1 << 56)
ROWS = 4096
FAN_IN = 8
SWEEPS = 60
EPS = np.finfo(float).eps
LONG = 1 << 63


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * GRID) + F.lit(BASE).cast("long"))


def usable(vector: Column) -> Column:
    """Not null and without null, non-finite or too large entries (NaN is above all numbers)."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, their vectors) by length, of at most ROWS rows."""
    lengths = column.value_lengths().to_numpy()
    values, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
    for dim in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == dim)
        for k in range(0, len(mine) if dim else 0, ROWS):
            some = mine[k : k + ROWS]
            yield some, values[at[some][:, None] + np.arange(dim)]


@dataclass
class Centre:
    """n distinct vectors with sums S: base = round(S / n), rest = S - n * base."""

    n: int
    base: np.ndarray
    rest: list[int]

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        base = [(2 * s + n) // (2 * n) for s in sums]
        return cls(n, np.array(base, np.int64), [s - n * b for s, b in zip(sums, base, strict=True)])

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (x - self.base) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; None beyond a long."""
        y = x - self.base
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * max(1, len(self.rest)) < LONG:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in y.tolist()]
        return [d if d < LONG else None for d in found]


def sums_of(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: n and the exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in blocks(batch.column(0)):
                far = int(np.abs(x).max(initial=0)) * len(x) >= LONG
                own = [sum(c) for c in x.T.tolist()] if far else x.sum(axis=0).tolist()
                n, sums = total.get(x.shape[1], (0, [0] * x.shape[1]))
                total[x.shape[1]] = (n + len(x), [a + b for a, b in zip(sums, own, strict=True)])
        for dim, (n, sums) in total.items():
            columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "at", "n", "total"])

    parts = distinct.select("x").mapInArrow(run, "dim int, at int, n long, total decimal(38,0)")
    rows = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim", "at").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["total"]))
    return out


TRIANGLE = "dim int, part int, r binary"


def _added(held: dict[int, np.ndarray], dim: int, rows: np.ndarray) -> None:
    held[dim] = np.linalg.qr(np.vstack([held[dim], rows]) if dim in held else rows, mode="r")


def _triangles(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    for dim, r in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["dim", "part", "r"])


def triangles(distinct: DataFrame, centres: dict[int, Centre]) -> dict[int, np.ndarray]:
    """R of the centred rows, by length."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in blocks(batch.column(0)):
                _added(held, x.shape[1], centres[x.shape[1]].rows(x))
        yield from _triangles(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, r in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                _added(held, dim, np.frombuffer(r).reshape(-1, dim))
        yield from _triangles(held)

    parts = distinct.rdd.getNumPartitions()
    out = distinct.select("x").mapInArrow(reduce, TRIANGLE)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        out = out.repartition(parts, F.floor(F.col("part") / FAN_IN)).mapInArrow(merge, TRIANGLE)
    held: dict[int, np.ndarray] = {}
    for row in out.collect():  # one a length
        _added(held, row["dim"], np.frombuffer(row["r"]).reshape(-1, row["dim"]))
    return held


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns (d even), as d - 1 rounds of disjoint ones."""
    ring = list(range(1, d))
    for _ in range(d - 1):
        seats = [0, *ring]
        yield np.array(seats[: d // 2]), np.array(seats[: d // 2 - 1 : -1])
        ring = ring[-1:] + ring[:-1]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the columns of r @ v, falling, and v, once rotations made them orthogonal."""
    d = r.shape[1]
    even = d + d % 2
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    a, v = np.zeros((r.shape[0], even)), np.eye(even)
    a[:, :d] = r[:, order]
    for _ in range(SWEEPS):
        turned = False
        for p, q in _rounds(even) if even > 1 else []:
            ap, aq = a[:, p], a[:, q]
            pp, qq, pq = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            turn = np.abs(pq) > 4 * EPS * np.sqrt(pp) * np.sqrt(qq)
            if not turn.any():
                continue
            turned, p, q = True, p[turn], q[turn]
            ap, aq = ap[:, turn], aq[:, turn]
            zeta = (qq[turn] - pp[turn]) / (2 * pq[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    lengths = np.linalg.norm(a, axis=0)
    best = np.argsort(-lengths, kind="stable")[:d]
    back = np.zeros((d, len(best)))
    back[order] = v[:d, best]
    return lengths[best], back


@dataclass
class Fit:
    """Of the vectors of one length. weights: a column a component; deviations: roots of e."""

    centre: Centre
    weights: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, centre: Centre, r: np.ndarray, most: int) -> Fit:
        lengths, v = jacobi(r)
        columns = np.linalg.norm(r, axis=0)
        rounding = 16 * max(r.shape) * EPS * np.linalg.norm(v * columns[:, None], axis=0)
        real = np.flatnonzero(lengths > rounding)[:most]
        v = v[:, real]
        if len(real):
            largest = np.abs(v).argmax(axis=0)
            v = v * np.where(v[largest, np.arange(len(real))] < 0, -1.0, 1.0)
        total = float((columns**2).sum())
        return cls(centre, v, lengths[real] / np.sqrt(centre.n), lengths[real] ** 2 / total if total else lengths[real])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.rows(x) @ self.weights) / self.deviations


def identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length, the largest distance of the whitened vectors' covariance from the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in blocks(batch.column(0)):
                z = fits[x.shape[1]](x)
                held[x.shape[1]] = held.get(x.shape[1], 0) + np.vstack([z.T @ z, z.sum(axis=0)])
        for dim, sums in held.items():
            flat = sums.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["dim", "at", "total"])

    parts = distinct.select("x").mapInArrow(run, "dim int, at int, total double")
    rows = parts.groupBy("dim", "at").agg(F.sum("total").alias("total")).orderBy("dim", "at").collect()
    totals: dict[int, list[float]] = {}
    for r in rows:
        totals.setdefault(r["dim"], []).append(r["total"])
    out = {}
    for dim, fit in fits.items():
        k = len(fit.deviations)
        sums = np.array(totals.get(dim, [])).reshape(k + 1, k) / fit.centre.n
        covariance = sums[:k] - np.outer(sums[k], sums[k])
        out[dim] = float(np.abs(covariance - np.eye(k)).max(initial=0))
    return out


def fit(vectors: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """By length of vector, the fit over the distinct usable ones."""
    scratch = Scratch(vectors.sparkSession)
    own = vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(whole(F.col(vector_col)).alias("x"))
    distinct = scratch.keep(own.distinct(), "vectors")
    centres = {dim: Centre.of(n, sums) for dim, (n, sums) in sums_of(distinct).items()}
    fits = {dim: Fit.of(centres[dim], r, components) for dim, r in triangles(distinct, centres).items()} if centres else {}
    for dim, error in identity_errors(distinct, fits).items():
        fits[dim].identity_error = error
    scratch.drop()
    return fits


def whiten(vectors: DataFrame, fits: dict[int, Fit], *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row: its id and the whitened vector, a number a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in blocks(batch.column(1)):
                z = fits[x.shape[1]](x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=["_id", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return _picked(vectors, id_col, vector_col).mapInArrow(run, f"_id {kind}, whitened array<double>").withColumnRenamed("_id", id_col)


def _picked(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(F.col(id_col).alias("_id"), whole(F.col(vector_col)).alias("x"))


def whitened_components(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained and
    identity_error."""
    fits = fit(vectors, vector_col=vector_col, components=components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in blocks(batch.column(1)):
                own = fits[x.shape[1]]
                k, m = len(own.deviations), len(x)
                each = np.repeat(np.arange(m), k)
                columns = [
                    batch.column(0).take(pa.array(rows[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, own.centre.n)),
                    pa.array(own.centre.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(own(x).ravel()),
                    pa.array(np.tile(own.explained, m)),
                    pa.array(np.full(m * k, own.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema[id_col].dataType.simpleString()
    out = _picked(vectors, id_col, vector_col).mapInArrow(run, f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("_id", id_col)
