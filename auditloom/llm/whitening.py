"""Embedding whitening by hierarchical merging of singular value decompositions.

Each entry c of a vector becomes the whole number floor(64 * c) + 1000000. The fit list holds each distinct vector of such
numbers once. A task keeps, of the vectors it has read, their number, their exact sums and all singular values and right
vectors of the centred rows (`Part`). Two parts merge without loss: the rows singular value times vector of both, and
one row for the difference of their means, are decomposed again. Parts merge FAN_IN at a time, level by level, each level a
table in the shared folder, until one is left; it is as large as the square of the dimension, however many vectors there are.
Its singular values and vectors are the components of the covariance, to double precision, as nothing was squared.

Means are kept as exact sums, and rows are centred before any product: offsets far larger than the spread cost no digits.
One more pass over the fit list measures the whitened covariance against the identity.

Defined results: rows whose vector is null or has null or non-finite entries are dropped; empty vectors have no components and
so no rows; vectors of each length are a space of their own, with their own fit list; entries of over 2**53 / 64 in size count as that bound; a component without
variance (a singular value under 1e-12 of the largest) has whitened null and no part in identity_error; without any variance
explained is null; a deviation that no long holds is null; repeated rows, null or repeated vec_id are kept, each row on its
own; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WorkDir, column, table

COMPONENTS = 16
FAN_IN = 8
BOUND = float(2**53)
NO_VARIANCE = 1e-12

_PART = "part long, dim int, n long, sums array<decimal(38,0)>, rows binary"


def whole_numbers(vectors: DataFrame, of: str) -> DataFrame:
    """vec_id and x, the whole numbers of each finite vector."""
    c = F.col(f"`{of}`")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    x = F.transform(c, lambda v: F.floor(F.least(F.greatest(v.cast("double") * 64, F.lit(-BOUND)), F.lit(BOUND))) + F.lit(1_000_000).cast("long"))
    return vectors.where(c.isNotNull() & (F.size(c) > 0) & finite).select("vec_id", x.alias("x"))


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sum of each column, as Python numbers where a long could overflow."""
    big = len(x) and int(np.abs(x).max()) * len(x) >= 2**62
    return (x.astype(object) if big else x).sum(axis=0).astype(object)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    lists = column(batch, "x")
    at = lists.offsets.to_numpy().astype(np.int64)
    values, length = lists.values.to_numpy(), np.diff(at)
    for dim in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == dim)
        yield rows, values[at[rows][:, None] + np.arange(dim)]


@dataclass
class Part:
    """n vectors: their exact sums, and singular values times right vectors of the centred rows, as many as there can be."""

    n: int
    sums: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Part:
        n, sums = len(x), exact_sums(x)
        return cls(n, sums, _decomposed(centred(x, n, sums)))

    def merge(self, other: Part) -> Part:
        n = self.n + other.n
        # the means' difference from exact sums, weighted so that its square is what centring both parts left out
        step = np.array([(int(a) * other.n - int(b) * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        return Part(n, self.sums + other.sums, _decomposed(np.vstack([self.rows, other.rows, np.sqrt(self.n / n * other.n) * step])))


def _decomposed(a: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    return s[:, None] * vt


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the whole part of the mean goes exactly, then the rest."""
    whole = [int(s) // n for s in sums]
    rest = np.array([(int(s) - w * n) / n for s, w in zip(sums, whole)])
    return (x - np.array(whole, np.int64)).astype(np.float64) - rest


def _write(parts: list[tuple[int, Part]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in parts], pa.int64()), pa.array([len(p.sums) for _, p in parts], pa.int32()), pa.array([p.n for _, p in parts], pa.int64()),
            pa.array([[Decimal(int(s)) for s in p.sums] for _, p in parts], pa.list_(pa.decimal128(38, 0))), pa.array([p.rows.tobytes() for _, p in parts], pa.binary()),
        ],
        ["part", "dim", "n", "sums", "rows"],
    )


def _read(row: dict) -> Part:
    return Part(row["n"], np.array([int(s) for s in row["sums"]], object), np.frombuffer(row["rows"]).reshape(-1, row["dim"]))


def task_parts(fit: DataFrame) -> DataFrame:
    """One part for each task and length of vectors."""

    def run(batches):
        of: dict[int, Part] = {}
        for batch in batches:
            for _, x in matrices(batch):
                new, dim = Part.of(x), x.shape[1]
                of[dim] = of[dim].merge(new) if dim in of else new
        if of:
            yield _write([(0, p) for p in of.values()])

    return fit.mapInArrow(run, _PART).withColumn("part", F.spark_partition_id().cast("long"))


def merged(parts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Parts of FAN_IN neighbours become one."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        out = _read(rows[0])
        for r in rows[1:]:
            out = out.merge(_read(r))
        return pa.Table.from_batches([_write([(rows[0]["part"] // fan_in, out)])])

    return parts.groupBy("dim", F.floor(F.col("part") / fan_in)).applyInArrow(run, _PART)


@dataclass
class Whitening:
    """Components of the vectors of one length, by falling variance."""

    n: int
    sums: np.ndarray
    axes: np.ndarray  # unit vectors, one a row
    deviations: np.ndarray  # square roots of the components' variances, nan where there is none
    explained: np.ndarray
    identity_error: float | None = None

    @classmethod
    def of(cls, part: Part, components: int) -> Whitening:
        dim = part.rows.shape[1]
        _, s, vt = np.linalg.svd(np.vstack([part.rows, np.zeros((max(0, dim - len(part.rows)), dim))]), full_matrices=False)
        variance = s**2 / part.n
        some = s > NO_VARIANCE * s[0] if s[0] > 0 else np.zeros(len(s), bool)
        share = variance / variance.sum() if s[0] > 0 else np.full(len(s), np.nan)
        k = min(components, dim)
        return cls(part.n, part.sums, vt[:k], np.where(some, np.sqrt(variance), np.nan)[:k], share[:k])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.axes.T / self.deviations

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums)^2, exact."""
        whole = np.array([int(s) // self.n for s in self.sums], np.int64)
        rest = [int(s) - int(w) * self.n for s, w in zip(self.sums, whole)]  # under n
        y = x - whole
        if (self.n * (int(np.abs(y).max()) + 1)) ** 2 * x.shape[1] < 2**62:
            return (((self.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1)).tolist()
        got = ((self.n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in got]


def fit(rows: DataFrame, work: WorkDir, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Length of vectors -> whitening, learned from the distinct x of all rows. What reaches the driver is one part a length."""
    spark = rows.sparkSession
    distinct = work.cut(rows.select("x").distinct(), "fit")
    parts = work.cut(task_parts(distinct), "parts")
    last = parts.agg(F.max("part")).first()[0]
    while last:
        parts = work.cut(merged(parts), "merged")
        last //= FAN_IN
    found = {r["dim"]: Whitening.of(_read(r.asDict()), components) for r in parts.collect()}
    shared = spark.sparkContext.broadcast(found)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                w = np.hstack([shared.value[x.shape[1]].whiten(x), np.ones((len(x), 1))])
                total[x.shape[1]] = total.get(x.shape[1], 0) + w.T @ w
        for dim, t in total.items():  # sums of products, the last row and column sums of the values themselves
            i, j = np.divmod(np.arange(t.size), len(t))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(t.ravel())], ["dim", "i", "j", "v"])

    sums = distinct.mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()
    for dim, w in found.items():
        k = len(w.axes)
        t = np.zeros((k + 1, k + 1))
        for r in sums:
            if r["dim"] == dim:
                t[r["i"], r["j"]] = r["v"]
        use = np.flatnonzero(~np.isnan(w.deviations))
        off = (t[:k, :k] / w.n - np.outer(t[k, :k], t[k, :k]) / w.n**2)[np.ix_(use, use)] - np.eye(len(use))
        w.identity_error = float(np.abs(off).max()) if len(use) else None
    return found


def whitened(vectors: DataFrame, of: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each finite vector and component."""
    spark = vectors.sparkSession
    work = WorkDir(spark, "whitening")
    rows = whole_numbers(vectors, of)
    shared = spark.sparkContext.broadcast(fit(rows, work, components))  # components x dimension numbers
    kind = to_arrow_type(vectors.schema["vec_id"].dataType)
    real = lambda v: pa.array(v, pa.float64(), from_pandas=True)  # noqa: E731  nan is null

    def run(batches):
        for batch in batches:
            for at, x in matrices(batch):
                w = shared.value[x.shape[1]]
                m, k = len(at), len(w.axes)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "vec_id").take(pa.array(np.repeat(at, k))).cast(kind), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n), pa.int64()),
                        pa.array(w.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), real(w.whiten(x).ravel()), real(np.tile(w.explained, m)), pa.array([w.identity_error] * (m * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    name = vectors.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {name}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
