"""Similarities of all pairs, or of many, as products of blocks.

Rows are dealt over blocks by the hash of a key that no large part of the rows shares; each pair of blocks is a group of its own, so a task holds two blocks
and a tile of their product, however many rows there are. Each row travels once for each block it meets. Blocks of vectors are so many that their pairs fill the
session's shuffle partitions, and more only where they would be larger than BLOCK_BYTES: until then what travels grows as the rows do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

BLOCK = 2048  # rows of a block, at least for vectors
BLOCK_BYTES = 32 << 20  # of a block of vectors as doubles, about
EACH = 4  # pairs of blocks for each shuffle partition, about
TILE = 512
DIGITS = 9  # similarities are rounded to these, so that those of equal vectors are 1


def _blocks(rows: DataFrame, block: int) -> int:
    return max(1, math.ceil(rows.count() / block))


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _vector_blocks(vectors: DataFrame, block: int, most: float) -> int:
    """Blocks of about `block` vectors; no more than `most` as long as they are within BLOCK_BYTES."""
    rows, entries = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    return max(1, math.ceil(min(rows, max(min(rows / block, most), 8 * entries / BLOCK_BYTES))))


def in_grid(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """rows with (bi, bj), bi <= bj: each once for each pair of blocks that its own is of; own: its block."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.withColumns({"bi": F.least("own", "met"), "bj": F.greatest("own", "met")}).drop("met")


def _units(col: pa.Array) -> np.ndarray:
    """The vectors as unit ones, a row each; a zero one stays zero."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def _tiles(a: np.ndarray, b: np.ndarray, tile: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for i in range(0, len(a), tile):
        for k in range(0, len(b), tile):
            yield i, k, np.round(a[i : i + tile] @ b[k : k + tile].T, DIGITS)


def _whole(vectors: DataFrame, *cols: str) -> DataFrame:
    """The rows whose vector is there and without nulls, as doubles; floats travel as such."""
    v, kind = F.col("embedding"), vectors.schema["embedding"].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)):
        v = v.cast("array<double>")
    return vectors.select(*cols, v.alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))


def pair_counts(vectors: DataFrame, edges: list[float], ordered: bool = False, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(bin, low, n): how many unordered pairs of different rows of `vectors` (vec_id, embedding) have a cosine from an
    edge up to the next; ordered: each pair counts twice. Similarities outside of the edges count nowhere, empty bins are
    there too. Rows with null vectors or entries are in no pair. All vectors are of one length. Only the counts of a pair
    of blocks leave its task."""
    parts = _parts(vectors)
    blocks = _vector_blocks(vectors, block, math.sqrt(2 * EACH * parts))

    def count(table: pa.Table) -> pa.Table:
        own, same = table.column("own").to_numpy(), table.column("bi")[0] == table.column("bj")[0]
        x = _units(table.column("embedding").combine_chunks())
        first = own == table.column("bi")[0].as_py()
        a, b = (x, x) if same else (x[first], x[~first])
        total = np.zeros(len(edges) + 1, np.int64)
        for i, k, s in _tiles(a, b, tile):
            if same and k < i:
                continue
            values = s[np.triu_indices(*s.shape[:1], 1, s.shape[1])] if same and k == i else s.ravel()
            total += np.bincount(np.searchsorted(edges, values, "right"), minlength=len(total))
        return pa.table({"bin": pa.array(np.arange(len(edges) - 1, dtype=np.int32)), "n": pa.array(total[1:-1] * (2 if ordered else 1))})

    grid = in_grid(_whole(vectors, "vec_id"), "vec_id", blocks).select("bi", "bj", "own", "embedding")
    grid = grid.repartition(parts, "bi", "bj")  # by number, or Spark joins parts that are small but long to work on
    found = grid.groupBy("bi", "bj").applyInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    bins = vectors.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, edges[:-1]))).alias("bin", "low"))
    return bins.join(found, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).alias("n"))


def over_threshold(probes: DataFrame, vectors: DataFrame, least: float, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(probe, vec_id, similarity): the vectors (vec_id, embedding) whose cosine with a probe of another vec_id, of the same
    columns, is over `least`, rounded. Both sides are dealt over blocks, so neither has to be small."""
    n, m = _vector_blocks(probes, block, EACH), _vector_blocks(vectors, block, _parts(vectors))
    spread = lambda rows, side, own, met, count, others: _whole(rows, F.col("vec_id")).select(
        F.lit(side).alias("side"), "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(met))
    rows = spread(probes, True, "bi", "bj", n, m).unionByName(spread(vectors, False, "bj", "bi", m, n))

    def near(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, x = table.column("vec_id").to_numpy(), _units(table.column("embedding").combine_chunks())
        p, q, out = ids[side], ids[~side], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, k, s in _tiles(x[side], x[~side], tile):
            at, to = np.nonzero((s > least) & (p[i : i + len(s), None] != q[None, k : k + s.shape[1]]))
            out.append((p[i + at], q[k + to], s[at, to]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"probe": pa.array(a), "vec_id": pa.array(b), "similarity": pa.array(s)})

    return rows.groupBy("bi", "bj").applyInArrow(near, "probe long, vec_id long, similarity double")


def grid_pairs(rows: DataFrame, key: str, less: Column, block: int = BLOCK) -> DataFrame:
    """Pairs of rows as structs a and b with `less` (over a and b), by blocks that meet in equal keys: no side is
    broadcast whole. Their number is what is asked for."""
    grid = in_grid(rows, key, _blocks(rows, block)).select("bi", "bj", "own", F.struct(*rows.columns).alias("r"))
    a, b = grid.select("bi", "bj", F.col("own").alias("oa"), F.col("r").alias("a")), grid.select("bi", "bj", F.col("own").alias("ob"), F.col("r").alias("b"))
    both = a.join(b, ["bi", "bj"]).where((F.col("bi") == F.col("bj")) | (F.col("oa") != F.col("ob")))
    return both.where(less).select("a", "b")
