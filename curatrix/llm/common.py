"""What several operators of this subpackage share: written tables, buckets, word hashes and packed hash sets.

Packed sets: a task works on a bucket of documents and sends, to each of many hash buckets, one row that holds
all its 64-bit hashes for that bucket. The rows of a bucket meet in one task, which sorts the numbers. Each task
sends a hash once, however often it holds it, so a passage that a third of all documents share costs a receiver
one entry per sender, not one per document.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 16 << 20
UNKNOWN_BYTES = 1 << 60
_LOCAL: list[tempfile.TemporaryDirectory] = []
_WRITTEN: dict[str, SparkSession] = {}


# --------------------------------------------------------------------------- written tables


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a local one only where that is unset and the session
    runs on this machine alone, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="curatrix-"))
            atexit.register(_LOCAL[0].cleanup)
        base = _LOCAL[0].name
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = work_path(df.sparkSession, label)
    _put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _put(df: DataFrame, path: str) -> None:
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN[path] = df.sparkSession
    df.write.parquet(path)


def removed(path: str) -> None:
    """Removes a written table that no later step reads."""
    spark = _WRITTEN.pop(path)
    if hasattr(spark, "_jsc"):
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    else:  # a remote session has no file system: an empty table takes its place
        spark.range(0).write.mode("overwrite").parquet(path)


def _remove_written() -> None:
    """Removes the written tables when the driver's Python ends, if its session still runs then."""
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):
            removed(path)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions for `df`: the session's number, or more where its size asks for more. A remote session
    doesn't tell the size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if hasattr(df, "_jdf") else UNKNOWN_BYTES
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, 1 if size >= UNKNOWN_BYTES else math.ceil(size / TARGET_BYTES))


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) as rows (id, component): each id that has an edge, and the smallest id
    that it reaches. Alternates large-star and small-star until nothing changes; each round is a written table,
    removed when the next one stands, and only its row count and checksum come to the driver."""
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    schema, path, last = e.schema, work_path(spark, "edges"), None
    _put(e, path)
    for _ in range(rounds):
        e = spark.read.schema(schema).parquet(path)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            e.join(low, "a").select("a", F.col("m").alias("b"))
        ).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        before, path, seen = path, work_path(spark, "edges"), Observation()
        _put(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), path)
        removed(before)
        now = seen.get
        if now == last:
            break
        last = now  # a task that ran twice may count twice: that costs a round
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    e = spark.read.schema(schema).parquet(path)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    )


HOT = 4096


def grouped_join(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """`rows` left-joined with `groups`, one row per `key` with its count n of rows. Fewer than HOT groups hold more than
    a part in HOT of the rows: these are broadcast, so no key of a hot group is shuffled, nor a null one. Both sides
    should be written tables, as they are read twice."""
    total = rows.count()
    is_hot = F.col("n") * HOT > total
    out = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.where(is_hot).withColumnRenamed(key, "hot_key"))
    near = rows.join(hot, rows[key] == hot["hot_key"], "left")
    done = near.where(F.col("hot_key").isNotNull() | F.col(key).isNull()).drop("hot_key")
    rest = near.where(F.col("hot_key").isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return done.unionByName(rest.join(groups.where(~is_hot), key, "left").select(*rows.columns, *out))


# --------------------------------------------------------------------------- documents in buckets


def bucketed(docs: DataFrame, n: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (b, doc_id, th, text): b a bucket of documents, th a hash of the text; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    return rows.select(F.pmod(F.xxhash64(F.coalesce("doc_id", "th")), F.lit(n)).cast("int").alias("b"), "doc_id", "th", "text")


INFO = "b int, kind int, doc_id long, th long, h binary"


def first_copies(rows: DataFrame) -> DataFrame:
    """INFO rows of kind 0: of each distinct text the row with the smallest doc_id. Rows without an id have none."""
    one = rows.where("doc_id is not null").groupBy(F.md5("text").alias("m")).agg(F.min(F.struct("doc_id", "th", "b")).alias("r"))
    return one.select("r.b", F.lit(0).alias("kind"), "r.doc_id", "r.th", F.lit(None).cast("binary").alias("h"))


def table_of(texts: pa.Table, info: pa.Table) -> tuple[list[int], list[bytes], list[bool], dict[int, np.ndarray]]:
    """Of one bucket, by doc_id: ids, texts, whether each is the first copy of its text; and the hashes by kind."""
    kinds = info.column("kind").to_numpy()
    first = set(zip(*(info.column(c).filter(pa.array(kinds == 0)).to_pylist() for c in ("doc_id", "th")), strict=True))
    blobs = {int(k): as_numbers(info.column("h").filter(pa.array(kinds == k))) for k in set(kinds.tolist()) - {0}}
    ids, ths = texts.column("doc_id").to_pylist(), texts.column("th").to_pylist()
    raw = texts.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, ths[i]))
    return [ids[i] for i in order], [raw[i] for i in order], [(ids[i], ths[i]) in first for i in order], blobs


# --------------------------------------------------------------------------- packed numbers


def as_numbers(col: pa.ChunkedArray | pa.Array, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in col.to_pylist() if x), kind)


def packs(bucket: np.ndarray, cols: dict[str, np.ndarray], name: str = "bucket") -> dict[str, pa.Array]:
    """One row per bucket with, for each column, the bytes of its numbers in that bucket."""
    order = np.argsort(bucket, kind="stable")
    got = bucket[order]
    at = np.flatnonzero(np.diff(got, prepend=got[:1] - 1)) if len(got) else np.zeros(0, np.int64)
    ends = np.append(at, len(got))
    out = {name: pa.array(got[at].astype(np.int32))}
    for k, v in cols.items():
        data = np.ascontiguousarray(v[order])
        out[k] = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
    return out


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n-1 of hashes."""
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def shared_by_two(rows: DataFrame, n: int, kind: int) -> DataFrame:
    """Rows (bucket, b, h): hashes that document bucket b holds, twice if two of its texts do. INFO rows with those
    of each b that two texts hold, wherever they are."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, bs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for x in batches:
            for b, h in zip(x.column("b").to_pylist(), x.column("h").to_pylist(), strict=True):
                hs.append(np.frombuffer(h, np.uint64))
                bs.append(np.full(len(hs[-1]), b, np.int32))
        h, b = np.concatenate(hs), np.concatenate(bs)
        order = np.argsort(h)
        h, b = h[order], b[order]
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[1:] |= same
        keep[:-1] |= same
        yield info_batch(b[keep], h[keep], kind)

    return rows.repartitionById(n, "bucket").mapInArrow(meet, INFO)


def once_or_twice(h: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """Each hash once, or twice if it has two holders: what shared_by_two wants from a document bucket."""
    order = np.lexsort((holder, h))
    h, holder = h[order], holder[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (holder[1:] != holder[:-1])
    h = h[new]
    keep = np.ones(len(h), bool)
    keep[2:] = (h[2:] != h[1:-1]) | (h[2:] != h[:-2])
    return h[keep]


def among_pairs(h: np.ndarray, g: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the pairs (h, g) are rows of `known`."""
    order = np.lexsort((known[:, 1], known[:, 0]))
    kh, kg = known[order, 0], known[order, 1]
    at, out = np.searchsorted(kh, h), np.zeros(len(h), bool)
    live = np.flatnonzero(at < len(kh))
    while len(live):  # one round, unless two pairs of one h are known
        live = live[(at[live] < len(kh))]
        live = live[kh[at[live]] == h[live]]
        same = kg[at[live]] == g[live]
        out[live[same]] = True
        live = live[~same]
        at[live] += 1
    return out


def numbered_pairs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number): where each distinct pair (h, g) stands first, and the number of each pair among those."""
    order = np.lexsort((g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def info_batch(b: np.ndarray, h: np.ndarray, kind: int) -> pa.RecordBatch:
    got = packs(b, {"h": h}, "b")
    none = pa.nulls(len(got["b"]), pa.int64())
    return pa.RecordBatch.from_pydict({"b": got["b"], "kind": pa.array(np.full(len(none), kind, np.int32)), "doc_id": none, "th": none, "h": got["h"]})


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are in `known`."""
    if not len(known):
        return np.zeros(len(h), bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


# --------------------------------------------------------------------------- hashes of bytes and words

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def paired(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the pair (a, b), in that order."""
    with np.errstate(over="ignore"):
        return mixed(a * _U(0xD6E8FEB86659FD93) + mixed(b + _U(salt + 0x632BE59B)) + _U(salt))


def grown(h: np.ndarray, length: int, to: int, salt: int = 0) -> np.ndarray:
    """Hashes of windows of `to` items from those of `length`, length <= to <= 2 * length."""
    if to == length:
        return h
    step = to - length
    return paired(h[: max(0, len(h) - step)], h[step:], salt * 131 + to)


def windows_of(h: np.ndarray, to: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of `to` items, by doubling from single ones."""
    length = 1
    while length < to:
        h, length = grown(h, length, min(2 * length, to), salt), min(2 * length, to)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the polynomial hashes, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def _in_block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], (~_SPACE[b]).view(np.int8), [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[b] * power[:-1], out=total[1:])
        return start, end, mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words_of(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, runs of bytes other than 0x20 and 0x09 to 0x0D. lower: A-Z count as
    a-z. Works through blocks cut at white space, so that memory beside the result stays small."""
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = _LOWER[b]
    out, at = [], 0
    while at < len(b):
        end = min(at + BLOCK, len(b))
        if end < len(b):
            gaps = np.flatnonzero(_SPACE[b[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[b[end:]])
                end = end + int(rest[0]) if len(rest) else len(b)
        s, e, h = _in_block(b[at:end])
        out.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a line feed between them, and the start of each."""
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return b"\n".join(texts), np.cumsum(size) - size


def pieces(texts: list[bytes], limit: int = 1 << 19, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes, or of one longer text, and of `most` texts."""
    pa.default_memory_pool().release_unused()  # of batches before this one
    at = size = 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > limit or i - at == most):
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


SLICE = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, without a copy: what Python makes of the texts of a slice is gone before the
    next one, so its memory does not follow the batch size."""
    for x in batches:
        for at in range(0, x.num_rows, rows):
            yield x.slice(at, rows)


def chunks(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most `limit`, or of one row of a larger size."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def no_nulls(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))
