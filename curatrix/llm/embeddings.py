"""Embedding near-dedup by collision counting on one-dimensional projections.

Two unit vectors with cosine c lie sqrt(2 - 2c) apart, and so do, in standard deviations, their projections on a
random direction. Vectors are sorted along a projection, and the window centred on each gives the vectors that it may
be near to; a pair collides on a projection when each lies in the window of the other. A pair goes on to the exact
cosine when it collides on at least as many of the projections as a pair at the threshold does with probability
RECALL_COUNT.

Windows on one projection alone hold a fixed share of all pairs, so their number would grow with the square of the
rows. Vectors are therefore sorted within cells that several projections make at once, in a number of tables that
grows with the logarithm of the row count. Cells per table and tables follow from the row count and the recall asked
for. What a pair shares is counted in the first table that joins it, so no link counts twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import connected, grouped_join, paired, partitions, written

COSINE = 0.95
RECALL = 0.97
RECALL_COUNT = 0.9995
COUNTED = 64
CELL = math.sqrt(10.0)
MATES = 20
WIDE = 4.0  # standard deviations that a window on the sorted projection reaches
BLOCK = 4096
PAIRS = 1 << 17


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _same_cell(s: float) -> float:
    """Probability that two values, N(0, s) apart, fall in one cell of width 1."""
    return 1 - 2 * _phi(-1 / s) - 2 * s / math.sqrt(2 * math.pi) * (1 - math.exp(-1 / (2 * s * s)))


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, float]:
    """Projections per table, tables and cell width for n vectors: about MATES unrelated vectors to a cell, and a
    pair at the threshold in one cell of some table with probability `recall`."""
    far = math.sqrt(2 - 2 * cosine)
    width = CELL * far
    near, random = _same_cell(far / width), _same_cell(math.sqrt(2) / width)
    t = max(1, round(math.log(max(n, 2 * MATES) / MATES) / -math.log(random)))
    return t, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**t))), width


def least_count(m: int = COUNTED, recall: float = RECALL_COUNT) -> int:
    """The most collisions of m that a pair at the threshold reaches with probability `recall`; windows reach as
    far as such a pair lies apart, so each collides with probability 0.683."""
    p = 2 * _phi(1) - 1
    tail = 0.0
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


def _directions(d: int, k: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, k))


def _packed(col: pa.Array, kind: str) -> np.ndarray:
    """The bytes of a binary column, one after the other, as numbers."""
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def _binary(data: np.ndarray, size: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A binary column of rows of `size` bytes of `data`, null where not valid; such rows have size 0."""
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [pa.array(valid).buffers()[1], pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _by_length(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths in bytes, and the rows of each."""
    size = pc.binary_length(col).to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        yield int(n), np.flatnonzero(size == n)


def _valid(kind: str):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            col = x.column("embedding")
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten()
            value = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0.0 becomes 0.0, so that equal vectors have equal bytes
            most = np.zeros(len(size))
            full = np.flatnonzero(size)
            if len(full):
                most[full] = np.maximum.reduceat(np.abs(value.astype(np.float64)), (np.cumsum(size) - size)[full])
            valid = (most > 0) & (most < math.inf)
            kept = value[np.repeat(valid, size)]
            yield pa.RecordBatch.from_pydict({"vec_id": x.column("vec_id"), "v": _binary(kept.view(np.uint8), np.where(valid, size * kept.itemsize, 0), valid)})

    return check


def _moderate(x: np.ndarray) -> np.ndarray:
    """The rows, each times the power of two that brings its largest component near 1: squares then neither overflow nor
    vanish, and no other bit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _cells(kind: str, t: int, tables: int, width: float):
    """Adds `codes`, the cell of each table, and `packed`, four bytes of each."""
    shift = np.random.Generator(np.random.PCG64(5)).random(t * tables) * width

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = x.column("v")
            codes = np.zeros((len(v), tables), np.uint64)
            for size, at in _by_length(v):
                u = _moderate(_packed(v.take(pa.array(at)), kind).reshape(len(at), -1).astype(np.float64))
                u /= np.sqrt((u * u).sum(1))[:, None]
                cell = np.floor((u @ _directions(u.shape[1], t * tables, 1) + shift) / width).astype(np.int64).view(np.uint64)
                h = np.full((len(at), tables), size, np.uint64)
                for k in range(t):
                    h = paired(h, cell[:, k::t], k)
                codes[at] = h
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * tables), pa.array(codes.view(np.int64).ravel()))
            short = _binary(codes.astype(np.uint32).view(np.uint8).ravel(), np.full(len(v), 4 * tables), np.ones(len(v), bool))
            yield x.append_column("codes", lists).append_column("packed", short)

    return code


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with edges (a, b)."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    use = label != np.arange(len(ids))
    return ids[use], ids[label[use]]


LINKED = "a long, b long, links long"


def _count_and_verify(kind: str, cosine: float, need: int):
    """Sorts each cell along the first of the counted projections; of the pairs within a window centred on one of
    both, wide enough for all pairs at the threshold, counts the collisions on all of them, and verifies."""
    reach = math.sqrt(2 - 2 * cosine)

    def windows(p: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (i, k) of one cell, k after i along the projection and in the window of i, by blocks."""
        place = cell * (4 * p.max(initial=1.0, where=np.isfinite(p)) + 4 * WIDE * reach + 4) + p  # sorted over all cells
        count = np.searchsorted(place, place + WIDE * reach * (1 + 1e-5), "right") - np.arange(len(p)) - 1
        ends = np.cumsum(count)
        at = 0
        while at < len(count):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            i = np.repeat(np.arange(at, to), count[at:to])
            yield i, i + 1 + np.arange(len(i)) - np.repeat(ends[at:to] - count[at:to] - base, count[at:to])
            at = to

    def work(rows: pa.Table) -> pa.RecordBatch:
        col = lambda c: rows.column(c).combine_chunks()
        key = np.stack([col(c).to_numpy() for c in ("tab", "code", "bi", "bj")]).astype(np.int64)
        v = col("v")
        x = _moderate(_packed(v, kind).reshape(len(v), -1).astype(np.float64))
        square = np.einsum("ij,ij->i", x, x)
        p = (x / np.sqrt(square)[:, None] @ _directions(x.shape[1], COUNTED, 2)).astype(np.float32)
        order = np.lexsort((p[:, 0], *key[::-1]))
        key, p, x, square = key[:, order], p[order], x[order], square[order]
        rep, n, side = (col(c).to_numpy()[order].astype(np.int64) for c in ("rep", "n", "x"))
        half, tab = key[2] != key[3], key[0]
        size = 4 * tab  # of each row the cells of the tables before this one, four bytes each
        before = np.zeros((len(rep), int(tab.max(initial=0))), np.int32)
        data, start = _packed(col("codes"), "<i4"), np.concatenate(([0], np.cumsum(size[np.argsort(order)])))[order] // 4
        for t in range(before.shape[1]):
            has = tab > t
            before[has, t] = data[start[has] + t]
        new = np.ones(len(rep), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        links, a, b = np.zeros(len(rep), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, k in windows(p[:, 0].astype(np.float64), np.cumsum(new) - 1):
            use = ~half[i] | (side[i] != side[k])  # of two blocks only the pairs across
            for t in range(before.shape[1]):  # a pair counts in the first table in which it shares a cell
                use &= (before[i, t] != before[k, t]) | (tab[i] <= t)
            i, k = i[use], k[use]
            hits = (np.abs(p[i] - p[k]) <= np.float32(reach * (1 + 1e-5))).sum(1)
            i, k = i[hits >= need], k[hits >= need]
            dot = np.einsum("ij,ij->i", x[i], x[k]) / np.sqrt(square[i] * square[k])
            i, k = i[dot >= cosine], k[dot >= cosine]
            np.add.at(links, i, n[k])
            np.add.at(links, k, n[i])
            a.append(rep[i])
            b.append(rep[k])
        ids, of = np.unique(rep, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, of, links)
        lower = forest(np.concatenate(a), np.concatenate(b))
        ids, total = ids[total > 0], total[total > 0]
        return pa.RecordBatch.from_pydict({
            "a": pa.array(np.concatenate((lower[0], ids))), "b": pa.array(np.concatenate((lower[1], ids))),
            "links": pa.array(np.concatenate((np.zeros(len(lower[0]), np.int64), total))),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            rows = pa.Table.from_batches(found)
            for _, at in _by_length(rows.column("v").combine_chunks()):
                yield work(rows if len(at) == rows.num_rows else rows.take(pa.array(at)))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding): how many other rows
    have a cosine, in double precision, of at least `cosine` with it; the smallest vec_id reachable by such links;
    and whether that is its own. No link below the threshold is returned; one at it is found with probability
    `recall`, nearer ones with a higher one. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths or rows without vec_id; finite components may be
    of any size. Rows with equal vectors link with each other. Rows that share a vec_id are vectors of their own: they
    link by cosine alone, each counts as a link, and a component is named by the smallest vec_id in it. Other columns are
    ignored. No rows in, none out."""
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    n_part = partitions(vectors)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = written(rows.mapInArrow(_valid(kind), "vec_id long, v binary").withColumn("k", F.md5("v")), "vectors")
    known = rows.where("v is not null and vec_id is not null")
    classes = known.groupBy("k").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # rep: the number of a class of equal vectors
    reps = known.join(classes, (known["vec_id"] == classes["least"]) & (known["k"] == classes["k"])).select("rep", "n", "v").dropDuplicates(["rep"])
    t, tables, width = tables_for(classes.count(), cosine, recall)
    coded = written(reps.mapInArrow(_cells(kind, t, tables, width), "rep long, n long, v binary, codes array<long>, packed binary"), "codes")
    cells = coded.select("rep", "n", "v", "packed", F.posexplode("codes").alias("tab", "code"))
    cells = cells.withColumn("codes", F.substring("packed", F.lit(1), 4 * F.col("tab"))).drop("packed")
    crowds = coded.select(F.posexplode("codes").alias("tab", "code")).groupBy("tab", "code").count().where(F.col("count") > BLOCK)
    crowds = written(crowds.select(F.col("tab").alias("t"), F.col("code").alias("c"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "crowds")  # its size is known from now on
    cells = cells.join(crowds, (F.col("tab") == F.col("t")) & (F.col("code") == F.col("c")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("x", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # each pair of blocks of a crowd is a task of its own
    cells = cells.select("rep", "n", "v", "codes", "tab", "code", "x", F.least("x", "y").alias("bi"), F.greatest("x", "y").alias("bj"))
    found = cells.repartition(n_part * 2, "tab", "code", "bi", "bj").mapInArrow(_count_and_verify(kind, cosine, least_count()), LINKED)
    found = written(found, "links")
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    part = written(connected(found.where("links = 0").select("a", "b")), "parts").withColumnRenamed("id", "rep")
    names = part.join(classes, "rep").groupBy("component").agg(F.min("least").alias("name"))
    groups = classes.join(links, "rep", "left").join(part, "rep", "left").join(names, "component", "left")
    groups = written(groups.select("k", "n", "links", F.coalesce("name", "least").alias("component")), "groups")
    rows = grouped_join(rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & F.col("v").isNotNull(), F.col("k")).alias("k")), groups, "k")
    component = F.coalesce("component", "vec_id")
    linked = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))
    return rows.select("vec_id", linked.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
part AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN part ON vec_id = id"""

