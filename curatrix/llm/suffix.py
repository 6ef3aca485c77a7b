"""Suffix-array dedup: a logarithmic family of suffix arrays over byte windows, in shards.

A window of `length` bytes belongs to the shard of its anchor, the gram of GRAM bytes in it with the smallest
hash, so equal windows meet. Anchors are looked up first, then the cores of the windows whose anchor two places hold:
what STEP windows around one anchor have in common. Only windows whose core two places hold go on. So a phrase that a
third of all documents hold between different neighbours sends its shard no more than the few bytes beside it that
are alike. Windows that follow each other share an anchor, so a run travels as one segment of text with its place.

In a shard, segments come in batches, of a BATCHES-th of the shard or of batch_bytes if that is more. Each batch gets a suffix array (ranks by prefix doubling, up to `length`
bytes) and is merge-scanned against the levels there are: the sorted windows of both meet by columns of eight bytes.
Of equal windows the earliest place stays in the level, the other is marked and leaves the batch, so no window is in
two levels; levels of about equal size merge. A segment that is there already needs no sorting: all its windows are
marked at once, or its place replaces a later one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import INFO, among, bucketed, first_copies, mixed, once_or_twice, packs, partitions, pieces, powers, shared_by_two, spread, table_of

LENGTH = 100
GRAM = 20
STEP = 8
BATCH_BYTES = 1 << 15
BATCHES = 16
_SPACE_BIT = np.uint64(1 << 63)
ANCHORS, RUNS, CORES = 1, 2, 3  # kinds of INFO rows: shared anchors, marked runs, shared cores


_BYTE = mixed(np.arange(99, 355, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the grams from each byte on: polynomials by doubling, mixed at the end."""
    h, size = _BYTE[data], 1
    while size < gram:
        step = min(size, gram - size)  # the last doubling may overlap; equal grams still have equal hashes
        h, size = h[: len(h) - step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:], size + step
    return mixed(h)


class _Segments:
    """The runs of windows of some texts that share an anchor: text number, first start, number of windows, hash."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        gram = min(GRAM, length)
        size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.at = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = max(0, len(self.data) - length + 1)
        h = _gram_hashes(self.data, gram)
        space = (self.data[: len(h)] == 32) | (self.data[: len(h)] == 10)
        h = np.where(space, h & ~_SPACE_BIT, h | _SPACE_BIT)  # grams that start with a space come first: fewer runs
        span, places = length - gram + 1, np.uint64((1 << max(1, len(h).bit_length())) - 1)
        low, width = (h & ~places) | np.arange(len(h), dtype=np.uint64), 1  # of equal hashes the leftmost
        while width < span:
            step = min(width, span - width)
            low, width = np.minimum(low[: len(low) - step], low[step:]), width + step
        low = (low[:n] & places).astype(np.int64)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        ok = doc[:n] == doc[length - 1 :] if n else np.zeros(0, bool)
        new = np.ones(n, bool)  # a run ends where the anchor's place changes or windows cross into the next text
        new[1:] = (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1]) | (ok[1:] != ok[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        use = ok[start] if n else np.zeros(0, bool)
        self.start, self.count = start[use], count[use]
        self.place = low[self.start]
        self.doc, self.anchor = doc[self.start], h[self.place]
        self.length = length

    def cores(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, first window, number of windows, hash) of the cores of some runs, in order of their windows. The
        windows that start from k * STEP to k * STEP + STEP - 1 bytes before the anchor are one core's."""
        step = min(STEP, self.length)
        place, most = self.place[runs], self.place[runs] - self.start[runs]
        least = most - self.count[runs] + 1
        n = most // step - least // step + 1
        of = np.repeat(np.arange(len(runs)), n)
        k = np.repeat(most // step, n) - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        first = place[of] - np.minimum(most[of], k * step + step - 1)
        last = place[of] - np.maximum(least[of], k * step)
        power, inverse = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[:-1], out=total[1:])
        at = place[of] - k * step
        h = mixed((total[at + self.length - step + 1] - total[at]) * inverse[at])
        return runs[of], first, last - first + 1, mixed(h + k.astype(np.uint64))

    def repeated(self, anchors: np.ndarray, cores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, first window, number of windows) of the stretches of windows whose anchor and core are known."""
        run, first, count, h = self.cores(np.flatnonzero(among(self.anchor, anchors)))
        use = np.flatnonzero(among(h, cores))
        new = np.ones(len(use), bool)
        new[1:] = (np.diff(use) > 1) | (np.diff(run[use]) > 0)
        at = np.flatnonzero(new)
        return run[use][at], first[use][at], np.add.reduceat(count[use], at) if len(at) else count[:0]


def _documents(texts: pa.Table, info: pa.Table) -> tuple[list[int], list[bytes], dict[int, np.ndarray]]:
    """Ids and texts of the first copies, each document once, and the hashes by kind."""
    ids, raw, first, sets = table_of(texts, info)
    use = [one and (k == 0 or ids[k] != ids[k - 1]) for k, one in enumerate(first)]
    return list(compress(ids, use)), list(compress(raw, use)), sets


def _find_anchors(length: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(texts: pa.Table, info: pa.Table) -> pa.Table:
        _, raw, _ = _documents(texts, info)
        hs, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in pieces(raw):
            s = _Segments(raw[i:j], length)
            hs.append(s.anchor)
            place.append(s.start + i * (1 << 32))
        return _lookup(texts, np.concatenate(hs), np.concatenate(place), parts)

    return find


def _find_cores(length: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(texts: pa.Table, info: pa.Table) -> pa.Table:
        _, raw, sets = _documents(texts, info)
        hs, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in pieces(raw):
            s = _Segments(raw[i:j], length)
            _, first, _, h = s.cores(np.flatnonzero(among(s.anchor, sets.get(ANCHORS, np.zeros(0, np.uint64)))))
            hs.append(h)
            place.append(first + i * (1 << 32))
        return _lookup(texts, np.concatenate(hs), np.concatenate(place), parts)

    return find


def _lookup(texts: pa.Table, h: np.ndarray, holder: np.ndarray, parts: int) -> pa.Table:
    """Rows (bucket, b, h) of the hashes of a document bucket."""
    h = once_or_twice(h, holder)
    out = packs(spread(h, parts), {"h": h})
    b = int(texts.column("b")[0].as_py()) if texts.num_rows else 0
    return pa.table({"bucket": out["bucket"], "b": pa.array(np.full(len(out["bucket"]), b, np.int32)), "h": out["h"]})


SENT = "bucket int, b int, whole boolean, anchor binary, doc binary, start binary, count binary, text binary"
_SENT = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("whole", pa.bool_()), *((c, pa.binary()) for c in ("anchor", "doc", "start", "count", "text"))])


def _send(length: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows for the shards: segments with their places, each distinct one of this bucket once, with its earliest
    place; and one row, `whole`, with the runs that are copies of those."""

    def find(texts: pa.Table, info: pa.Table) -> pa.Table:
        ids, raw, sets = _documents(texts, info)
        anchors, cores = (sets.get(k, np.zeros(0, np.uint64)) for k in (ANCHORS, CORES))
        seen: set[bytes] = set()
        got: dict[int, list[tuple]] = {}
        copies: list[tuple[int, int, int]] = []
        for i, j in pieces(raw):
            s = _Segments(raw[i:j], length)
            buckets = spread(s.anchor, shards)
            for k, start, count in zip(*(x.tolist() for x in s.repeated(anchors, cores)), strict=True):
                text = s.data[start : start + count + length - 1].tobytes()
                doc = int(s.doc[k])
                place = (ids[i + doc], int(start - s.at[doc]), count)
                if text in seen:  # texts come by doc_id and place, so the one seen before is the earlier
                    copies.append(place)
                else:
                    seen.add(text)
                    got.setdefault(int(buckets[k]), []).append((int(s.anchor[k]), *place, text))
        b = int(texts.column("b")[0].as_py()) if texts.num_rows else 0
        rows = [(bucket, b, False, *_columns(x)) for bucket, x in got.items()]
        if copies:
            rows.append((b % shards, b, True, *_columns([(0, *p, b"") for p in copies])))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SENT, strict=True)], _SENT) if rows else _SENT.empty_table()

    return find


def _columns(x: list[tuple]) -> tuple[bytes, ...]:
    anchor, doc, start, count, text = zip(*x, strict=True)
    return np.array(anchor, np.uint64).tobytes(), np.array(doc, np.int64).tobytes(), np.array(start, np.int64).tobytes(), np.array(count, np.int32).tobytes(), b"".join(text)


def _ranked(key: np.ndarray) -> np.ndarray:
    """The rank of each key, equal ones alike."""
    order = np.argsort(key)
    key = key[order]
    rank = np.zeros(len(key), np.uint64)
    rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.uint64)
    return rank


class _Level:
    """Windows in suffix order, each window of the text once, with its earliest place."""

    def __init__(self, segments: list[bytes], windows: list[tuple[int, int, int]], length: int) -> None:
        """windows: of each segment, the doc_id, first start and number of its windows."""
        self.length = length
        self.text = np.frombuffer(b"".join(segments), np.uint8)
        count = np.array([w[2] for w in windows], np.int64)
        size = count + length - 1
        at, inner = np.cumsum(size) - size, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.at = np.repeat(at, count) + inner
        self.doc = np.repeat(np.array([w[0] for w in windows], np.int64), count)
        self.start = np.repeat(np.array([w[1] for w in windows], np.int64), count) + inner

    def _ranks(self) -> np.ndarray:
        """Rank of the `length` bytes from each window's start, by prefix doubling over the text."""
        rank, size = self.text.astype(np.uint64), 1
        while 2 * size <= min(4, self.length):  # up to four bytes are their own rank
            rank, size = (rank[:-size] << np.uint64(8 * size)) | rank[size:], 2 * size
        while size < self.length:
            step = min(size, self.length - size)
            if size > 4 and step == size < self.length - size and len(self.text) < 1 << 21:  # three short ranks fit a number
                far = min(2 * size, self.length - size)
                key = (rank[: len(rank) - far] << np.uint64(42)) | (rank[size : len(rank) - far + size] << np.uint64(21)) | rank[far:]
                step = far
            else:
                key = (rank[: len(rank) - step] << np.uint64(32)) | rank[step:]
            rank, size = _ranked(key), size + step
        return rank[self.at]

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Puts the windows in suffix order and returns (doc, start) of those with an earlier equal one, which leave."""
        rank = self._ranks()
        order = np.lexsort((self.start, self.doc, rank))
        rank = rank[order]
        later = np.zeros(len(order), bool)
        later[1:] = rank[1:] == rank[:-1]
        gone, stay = order[later], order[~later]
        out = self.doc[gone], self.start[gone]
        self.at, self.doc, self.start = self.at[stay], self.doc[stay], self.start[stay]
        return out

    def _column(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 * k to 8 * k + 7 of the windows of some rows, as numbers in the order of the bytes; the last
        column overlaps the one before it."""
        size = min(8, self.length)
        every = np.ndarray(len(self.text) - size + 1, f">u{size}" if size in (1, 2, 4, 8) else f"S{size}", self.text, strides=(1,))
        return every[self.at[rows] + min(8 * k, self.length - size)].astype(every.dtype.newbyteorder("="))

    def places_of(self, other: _Level) -> tuple[np.ndarray, np.ndarray]:
        """For each window of `other`, in order, how many of this level's come before it, and whether the next one is
        equal: column by column, each within the range that the columns before it left."""
        low, high, live = np.zeros(len(other.at), np.int64), np.full(len(other.at), len(self.at)), np.arange(len(other.at))
        for k in range(-(-self.length // 8)):
            key = other._column(live, k)
            if k == 0:
                column = self._column(np.arange(len(self.at)), 0)
                low, high = np.searchsorted(column, key), np.searchsorted(column, key, "right")
            else:
                a, z = low[live], high[live]
                low[live], high[live] = self._bisect(k, key, a, z, np.less), self._bisect(k, key, a, z, np.less_equal)
            live = np.flatnonzero(high > low)
            if not len(live):
                break
        return low, high > low

    def _bisect(self, k: int, key: np.ndarray, low: np.ndarray, high: np.ndarray, before: Callable) -> np.ndarray:
        """For each key the first row from low to high whose column k is not before it."""
        low, high, live = low.copy(), high.copy(), np.arange(len(low))
        while len(live := live[low[live] < high[live]]):
            mid = (low[live] + high[live]) >> 1
            go = before(self._column(mid, k), key[live])
            low[live[go]], high[live[~go]] = mid[go] + 1, mid[~go]
        return low

    def scan(self, new: _Level) -> tuple[np.ndarray, np.ndarray]:
        """(doc, start) of the later one of each pair of equal windows of this level and `new`; those of `new` leave
        it, and this level keeps the earlier place."""
        at, same = self.places_of(new)
        mine, its = at[same], np.flatnonzero(same)
        first = (new.doc[its] < self.doc[mine]) | ((new.doc[its] == self.doc[mine]) & (new.start[its] < self.start[mine]))
        out = tuple(np.where(first, a[mine], b[its]) for a, b in ((self.doc, new.doc), (self.start, new.start)))
        self.doc[mine[first]], self.start[mine[first]] = new.doc[its[first]], new.start[its[first]]
        new.at, new.doc, new.start = new.at[~same], new.doc[~same], new.start[~same]
        return out

    def merged(self, other: _Level) -> _Level:
        """Both levels as one, their sorted windows merged; they have none in common."""
        at, _ = self.places_of(other)
        out = object.__new__(_Level)
        out.length, out.text = self.length, np.concatenate((self.text, other.text))
        out.at = np.insert(self.at, at, other.at + len(self.text))
        out.doc, out.start = np.insert(self.doc, at, other.doc), np.insert(self.start, at, other.start)
        return out


def _index(levels: list[_Level], new: _Level) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Puts a batch into the family of levels and yields the windows to mark."""
    yield new.sort()
    for level in levels:
        yield level.scan(new)
    levels.append(new)
    while len(levels) > 1 and len(levels[-2].at) <= 2 * len(levels[-1].at):
        last = levels.pop()
        levels.append(levels.pop().merged(last))


def _shard(rows: list[tuple], length: int, batch_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Marked runs (doc, first start, number) of a shard from rows (anchor, doc, start, count, text)."""
    whole: dict[bytes, list[tuple[int, int, int]]] = {}
    anchors: dict[int, set[bytes]] = {}
    for anchor, doc, start, count, text in rows:
        at, a, d, s = 0, np.frombuffer(anchor, np.uint64).tolist(), np.frombuffer(doc, np.int64).tolist(), np.frombuffer(start, np.int64).tolist()
        for x, p, q, c in zip(a, d, s, np.frombuffer(count, np.int32).tolist(), strict=True):
            t = text[at : at + c + length - 1]
            at += len(t)
            whole.setdefault(t, []).append((p, q, c))
            anchors.setdefault(x, set()).add(t)
    runs = []
    for places in whole.values():
        if len(places) > 1:
            places.sort()
            runs += places[1:]
    if runs:
        yield tuple(np.array(c, np.int64) for c in zip(*runs, strict=True))
    todo = [(t, whole[t][0]) for ts in anchors.values() if len(ts) > 1 for t in ts]
    batch_bytes = max(batch_bytes, -(-sum(len(t) for t, _ in todo) // BATCHES))
    levels: list[_Level] = []
    marks: list[tuple[np.ndarray, np.ndarray]] = []
    again: list[tuple[bytes, tuple[int, int, int]]] = []
    size = 0
    for i, x in enumerate(todo):
        again.append(x)
        size += len(x[0])
        if size >= batch_bytes or i + 1 == len(todo):
            marks += _index(levels, _Level([t for t, _ in again], [p for _, p in again], length))
            again, size = [], 0
    if marks:
        doc, start = (np.concatenate(c) for c in zip(*marks, strict=True))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
        at = np.flatnonzero(new)
        if len(at):
            yield doc[at], start[at], np.maximum.reduceat(start, at) - start[at] + 1


def _scan_shards(length: int, batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Marked runs of the shards of a task, as INFO rows of kind RUNS; b is the bucket of the document."""

    def give(b: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        runs = np.stack((doc, start, count), 1).astype(np.int64)
        got = packs(b, {"h": runs.view("V24").ravel()}, "b")
        none = pa.nulls(len(got["b"]), pa.int64())
        return pa.RecordBatch.from_pydict({"b": got["b"], "kind": pa.array(np.full(len(none), RUNS, np.int32)), "doc_id": none, "th": none, "h": got["h"]})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[tuple]] = {}
        for x in batches:
            for bucket, b, whole, *cols in zip(*(x.column(f.name).to_pylist() for f in _SENT), strict=True):
                if whole:
                    doc, start, count = (np.frombuffer(c, k) for c, k in zip(cols[1:4], (np.int64, np.int64, np.int32), strict=True))
                    yield give(np.full(len(doc), b, np.int32), doc, start, count.astype(np.int64))
                else:
                    shards.setdefault(bucket, []).append((b, *cols))
        while shards:
            rows = shards.popitem()[1]
            doc = np.concatenate([np.frombuffer(x[2], np.int64) for x in rows])
            b = np.concatenate([np.full(len(x[2]) // 8, x[0], np.int32) for x in rows])
            doc, at = np.unique(doc, return_index=True)
            for runs in _shard([x[1:] for x in rows], length, batch_bytes):
                yield give(b[at][np.searchsorted(doc, runs[0])], *runs)

    return scan


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _kept(length: int, digest: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut(texts: pa.Table, info: pa.Table) -> pa.Table:
        ids, raw, first, sets = table_of(texts, info)
        runs = sets.get(RUNS, np.zeros(0, np.uint64)).view(np.int64).reshape(-1, 3)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        out: dict[str, list] = {k.split()[0]: [] for k in RESULT.split(", ")}
        for i, t, one in zip(ids, raw, first, strict=True):
            kept, removed, spans = t, 0, 0
            if one:
                a, z = np.searchsorted(runs[:, 0], (i, i + 1))
                if z > a:
                    cover = np.zeros(len(t) + 1, np.int32)
                    np.add.at(cover, runs[a:z, 1], 1)
                    np.add.at(cover, np.minimum(runs[a:z, 1] + runs[a:z, 2] + length - 1, len(t)), -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    kept, removed = np.frombuffer(t, np.uint8)[~gone].tobytes(), int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            elif i is not None and len(t) >= length:  # a later copy: all of it starts in the first copy
                kept, removed, spans = b"", len(t), 1
            for k, v in zip(out, (i, len(t), removed, spans, hashlib.sha256(kept).hexdigest().encode() if digest else kept), strict=True):
                out[k].append(v)
        return pa.table(out, pa.schema([(k, pa.binary() if k == "kept" else pa.int64()) for k in out]))

    return cut


def suffix_dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of `docs` (doc_id, text): the UTF-8 text without
    each byte that a string of `length` bytes covers which also starts earlier, in a document with a smaller
    doc_id or before in its own; kept bytes as binary, or with `digest` the hex SHA-256 of them. Strings are judged
    on the input and never cross documents. Null and empty texts have no bytes. Equal rows are
    one document and get the same result. Rows without doc_id stay whole and take nothing from others. doc_id names one
    text; where two texts share one, both count as that document. Other columns are ignored. No rows, none out."""
    n = partitions(docs)
    buckets, shards, parts = 4 * n, 4 * n, max(1, n // 2)  # each document bucket sends a row to each part that has one of its hashes
    rows = bucketed(docs, buckets)
    groups = rows.groupBy("b")
    info = first_copies(rows)
    sent = groups.cogroup(info.groupBy("b")).applyInArrow(_find_anchors(length, parts), "bucket int, b int, h binary")
    known = info.union(shared_by_two(sent, parts, ANCHORS))
    sent = groups.cogroup(known.groupBy("b")).applyInArrow(_find_cores(length, parts), "bucket int, b int, h binary")
    known = known.union(shared_by_two(sent, parts, CORES))
    sent = groups.cogroup(known.groupBy("b")).applyInArrow(_send(length, shards), SENT)
    runs = sent.repartition(n, "bucket").mapInArrow(_scan_shards(length, batch_bytes), INFO)
    return groups.cogroup(info.union(runs).groupBy("b")).applyInArrow(_kept(length, digest), RESULT)


def op10_suffix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs, LENGTH, digest=True).withColumn("kept_sha256", F.col("kept").cast("string")).drop("kept")



OP10_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, {2 * LENGTH}) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(h) >= {2 * LENGTH})),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS p FROM later),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans
    FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY 1),
each AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM d),
kept AS (SELECT e.doc_id, string_agg(substr(h, (2 * e.p + 1)::BIGINT, 2), '' ORDER BY e.p) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""
