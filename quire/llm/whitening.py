"""Embedding whitening (operator 12): exact integer means, a second pass for the covariance, LAPACK, projection.

Entries become integers x = floor(64 c) + 1000000.  The first pass adds them up exactly, in three limbs of 21 bits,
so no sum overflows.  The second centres each vector by the exact mean (whole part first, then the fraction) and
adds up outer products by GEMM, one matrix a task; partial matrices are merged by ``treeAggregate``.  ``eigh`` of
the covariance runs in the driver on dims x dims numbers; the projection travels with the tasks.  A third pass
measures the covariance of what comes out.

Rows whose vector is null, empty, or holds a null or an entry that is not finite are left out, as are entries too
large for x to be an exact double (2**53 and more).  The dimension is that of most vectors (of equally many, the greater);
vectors of another length are left out.  Repeated rows, equal vectors and null ids are rows as any other.
Components without variance (an eigenvalue of at most 1e-12 of the greatest) have null whitened values, take no part in the
identity error, and explain 0.  ``deviation`` is null where it does not fit in 64 bits.  Extra columns are left out.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LIMB = 21
ROWS = 2048  # vectors of a GEMM
FLAT = 1e-12


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the rows that take part, and their dimension."""
    most = float(2**53 // SCALE - SHIFT)
    good = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < most, F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(0.0)))))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()
    d = int(sizes.m.d) if sizes.m else 0
    return good.where(F.size("v") == d), d


def integers(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    """x of the rows of a batch, some at a time."""
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for lo in range(0, len(v), ROWS):
        yield np.floor(SCALE * v[lo : lo + ROWS]).astype(np.int64) + SHIFT


def tree_sum(vectors: DataFrame, zero: np.ndarray, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of what ``of`` gives for each batch: one array a task, merged as a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero.copy()
        for batch in batches:
            total += of(batch)
        yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

    kind, shape = zero.dtype, zero.shape
    sums = vectors.mapInArrow(partial, "sum binary").rdd.map(lambda r: np.frombuffer(r[0], kind).reshape(shape))
    return sums.treeAggregate(zero, lambda a, b: a + b, lambda a, b: a + b)


class Mean:
    """The exact mean S / n of integer vectors, as whole part and rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.fraction = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S) squared, exactly."""
        off = x - self.whole
        most = int(np.abs(off).max(initial=0)) + 1
        if (self.n * most) ** 2 * x.shape[1] < 2**63:
            wide = self.n * off - np.array(self.rest, np.int64)
            return (wide * wide).sum(axis=1).tolist()
        exact = [sum((self.n * int(o) - r) ** 2 for o, r in zip(row, self.rest, strict=True)) for row in off]
        return [e if e < 2**63 else None for e in exact]


def mean(vectors: DataFrame, d: int) -> Mean | None:
    mask = (1 << LIMB) - 1

    def of(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((4, d), np.int64)
        for x in integers(batch, d):
            out += np.stack([(x & mask).sum(axis=0), ((x >> LIMB) & mask).sum(axis=0), (x >> 2 * LIMB).sum(axis=0), np.full(d, len(x))])
        return out

    total = tree_sum(vectors, np.zeros((4, d), np.int64), of)
    n = int(total[3, 0]) if d else 0
    return Mean(n, [int(a) + (int(b) << LIMB) + (int(c) << 2 * LIMB) for a, b, c in total[:3].T]) if n else None


def covariance(vectors: DataFrame, d: int, middle: Mean, project: np.ndarray | None = None) -> np.ndarray:
    """The covariance over all vectors, divisor n; of their projections, if one is given."""
    k = d if project is None else project.shape[1]

    def of(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((k, k))
        for x in integers(batch, d):
            y = middle.centred(x)
            y = y if project is None else y @ project
            out += y.T @ y
        return out

    return tree_sum(vectors, np.zeros((k, k)), of) / middle.n


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and leading component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    out = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good, d = usable(vectors, id_col, vec_col)
    middle = mean(good, d) if d else None
    if middle is None:
        return vectors.sparkSession.createDataFrame([], out)
    v = covariance(good, d, middle)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    k = min(components, d)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(v))
    own = int((values[:k] > FLAT * max(values[0], 0.0)).sum()) if trace > 0 else 0
    project = axes[:, :own] / np.sqrt(values[:own])
    error = float(np.abs(covariance(good, d, middle, project) - np.eye(own)).max()) if own else None
    explained = [max(0.0, float(e)) / trace if i < own else 0.0 for i, e in enumerate(values[:k])]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in integers(batch, d):
                m = len(x)
                w = np.full((m, k), np.nan)
                w[:, :own] = middle.centred(x) @ project
                ids = pa.array(np.repeat(np.arange(at, at + m), k))
                deviation = pa.array(middle.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [batch.column("id").take(ids), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, middle.n)), deviation, pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(explained, m)), pa.array([error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in out.split(", ")])
                at += m

    return good.mapInArrow(projected, out)
