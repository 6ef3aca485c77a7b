"""Embedding whitening: principal components by MLlib's computeSVD on centred distributed rows.

Entries become integers, floor(256 * c). The components are fitted on the distinct vectors: their rows, centred, go
through RowMatrix.computeSVD, whose singular values s give the eigenvalues s * s / n of the covariance with divisor n.
The total variance is not the sum of those but comes from exact integer deviations. All components are asked for, not
only those returned: then MLlib decomposes the d by d Gramian directly, to double precision, instead of by iteration to
a tolerance. The driver holds that matrix and the mean, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import written

SCALE = 256
COMPONENTS = 4
LEAST = 1e-6  # of the largest singular value: smaller ones are rounding
ROWS = 2048
DIRECT = 15000  # dimensions up to which MLlib decomposes the Gramian as a whole


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The integers of each vector as bytes of int64, null where it is null, empty or not finite."""
    for big in batches:
        for at in range(0, big.num_rows, ROWS):
            x = big.slice(at, ROWS)
            col = x.column("embedding")
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            value = col.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.ones(len(size), bool)
            good[np.repeat(np.arange(len(size)), size)[~np.isfinite(value)]] = False
            good &= size > 0
            with np.errstate(over="ignore"):
                level = np.clip(np.floor(SCALE * value[np.repeat(good, size)]), -(2.0**63), 2.0**63 - 1024).astype("<i8")
            ends = np.cumsum(np.where(good, 8 * size, 0)).astype(np.int32)
            xs = pa.BinaryArray.from_buffers(pa.binary(), len(size), [pa.array(good).buffers()[1], pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(level)])
            yield pa.RecordBatch.from_pydict({"vec_id": x.column("vec_id"), "size": pa.array(size.astype(np.int32)), "x": xs})


def levels(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, x) of the vectors (vec_id, embedding) that are finite and not empty: x their integers as bytes."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_levels, "vec_id long, size int, x binary").where("x is not null")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<i8").reshape(len(col), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task per dimension, in two halves that cannot overflow, and the least and largest entries."""
    high = low = least = most = None
    for x in batches:
        if not x.num_rows:
            continue
        v = _matrix(x.column("x"))
        got = (v >> 32).sum(0), (v & 0xFFFFFFFF).sum(0), v.min(0), v.max(0)
        if high is None:
            high, low, least, most = (g.astype(object) if k < 2 else g for k, g in enumerate(got))
        else:
            high, low, least, most = high + got[0], low + got[1], np.minimum(least, got[2]), np.maximum(most, got[3])
    if high is not None:
        total = pa.array([int(h) * 2**32 + int(b) for h, b in zip(high, low, strict=True)], pa.decimal128(38))
        yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(len(total), dtype=np.int32)), "s": total, "lo": pa.array(least), "hi": pa.array(most)})


def _centred(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = _matrix(x.column("x")) - mean
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(mean)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_pydict({"v": lists})

    return run


class Whitening:
    """A fit on n vectors with the exact sums S: components as columns, by falling eigenvalue. reach: the largest
    absolute entry of n * x - S."""

    def __init__(self, n: int, sums: list[int], reach: int, components: np.ndarray, values: np.ndarray) -> None:
        self.n, self.sums, self.components, self.values = n, sums, components, values
        self.mean = np.array([s / n for s in sums])
        self.small = reach < math.isqrt((2**63 - 1) // len(sums))  # every deviation fits 64 bits
        self.kind = "long" if self.small else "string"

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact: in 64 bits, whose overflow within n * x - S cancels out, or as text of any length."""
        if self.small:
            with np.errstate(over="ignore"):
                gap = x * np.int64(self.n) - np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], np.int64)
            return pa.array(np.einsum("ij,ij->i", gap, gap))
        gap = x.astype(object) * self.n - np.array(self.sums, object)
        return pa.array([str(int(f)) for f in (gap * gap).sum(1)], pa.string())

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)


def _projected(fit: Whitening, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                rows = big.slice(at, ROWS)
                x = _matrix(rows.column("x"))
                w = np.ascontiguousarray(fit.whitened(x))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                own = {"vec_id": rows.column("vec_id")} if ids else {}
                yield pa.RecordBatch.from_pydict(own | {"deviation": fit.deviations(x), "w": lists})

    return run


def fitted(distinct: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The fit on the rows of `distinct` (x: `size` integers as bytes); None without rows or variance."""
    n = distinct.count()
    sums = distinct.mapInArrow(_sums, "pos int, s decimal(38,0), lo long, hi long").groupBy("pos").agg(F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = sorted(sums.collect())  # one row a dimension
    total = [int(r.s) for r in found]
    reach = max((max(n * r.hi - s, s - n * r.lo) for r, s in zip(found, total, strict=True)), default=0)
    if reach == 0:
        return None
    rows = distinct.mapInArrow(_centred(np.array([s / n for s in total])), "v array<double>").select(array_to_vector("v").alias("v"))
    most = size if size <= DIRECT else min(components, size - 1)
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), n, size).computeSVD(most, False, LEAST)
    s = svd.s.toArray()[:components]
    s = s[s > 0]
    return Whitening(n, total, reach, svd.V.toArray()[:, : len(s)], s * s / n)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each row of `vectors` (vec_id,
    embedding) and component. Vectors that are null, empty or hold null or non-finite entries are left out, and so are
    those of another length than most (the longer one, if two are as frequent). Entries whose integer is beyond 64 bits
    count as the nearest one within. Equal vectors count once in the fit; repeated rows and ids, and rows without id,
    are returned as often as they come. Components without variance are not returned, so vectors that are all equal
    give no rows; nor does an empty table. A deviation beyond 64 bits is null. Other columns are ignored."""
    known = levels(vectors)
    sizes = known.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    none = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], none)
    size = sizes[0]["size"]
    known = known.where(F.col("size") == size)
    distinct = written(known.select("x").distinct(), "fit")
    fit = fitted(distinct, size, components)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], none)
    k = len(fit.values)
    seen = distinct.mapInArrow(_projected(fit, False), f"deviation {fit.kind}, w array<double>").select("deviation", *[F.col("w")[i].alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    spread = F.sum(F.col("deviation").cast("decimal(38,0)" if fit.small else "double"))
    got = seen.agg(spread, *[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    variance = (int(got[0]) if fit.small else got[0]) / fit.n**3
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, got[1:], strict=True))
    rows = known.mapInArrow(_projected(fit, True), f"vec_id long, deviation {fit.kind}, w array<double>")
    rows = rows.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("w").alias("pos", "whitened"))
    shares = F.array(*[F.lit(float(e / variance)) for e in fit.values])
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("pos")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
