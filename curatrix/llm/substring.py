"""Substring dedup by level-wise doubling over word windows.

Windows of a short length are looked up first; only those that two documents hold are extended to twice that
length, and so on up to the length asked for, until no candidate is left. The shortest level is thinned: of each
full-length window only the sub-window with the smallest hash (its anchor) is looked up. Equal windows have equal
anchors, so a window whose anchor is in one document only cannot repeat, and nothing is lost.

Documents stay in document buckets. What travels are sets of 64-bit hashes, each once per document bucket, to the
bucket of the hash and back; so a passage that a third of all documents hold costs its receiver one entry per
document bucket. The lookups of the shorter levels only narrow the candidates; the last level decides, and compares
128 bits of hash on the way there and back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curatrix.llm.common import INFO, among, among_pairs, bucketed, first_copies, info_batch, joined, numbered_pairs, once_or_twice, packs, partitions, pieces, shared_by_two, spread, table_of, windows_of, words_of

N_WORDS = 13
SHORTEST = 8


def levels_for(n: int) -> list[int]:
    """Window lengths to look up: n halved, rounding up, down to SHORTEST or less."""
    out = [n]
    while out[0] > SHORTEST or len(out) == 1 and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each start of `span` consecutive items the index of the smallest of them."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best, width = np.where(h[a] <= h[b], a, b), width + step
    return best[:n]


class _Windows:
    """The words of some texts and, for each start of a window of n words within one text, its hashes."""

    def __init__(self, texts: list[bytes], n: int) -> None:
        data, at = joined(texts)
        start, _, word = words_of(data)
        doc = np.searchsorted(at, start, "right") - 1
        last = max(0, len(doc) - n + 1)
        self.levels, self.word, self.doc = levels_for(n), word, doc
        self.ok = doc[:last] == doc[n - 1 :] if last else np.zeros(0, bool)
        self.base = windows_of(word, self.levels[0])
        self.anchor = _anchors(self.base, n - self.levels[0] + 1)[: len(self.ok)]

    def known(self, level: int, sets: dict[int, np.ndarray]) -> np.ndarray:
        """Which windows of n words are made of windows that the lookups of the levels before `level` let pass."""
        if level == 0:
            return self.ok
        out = self.ok & among(self.base, sets.get(1, np.zeros(0, np.uint64)))[self.anchor]
        for k in range(1, level):
            size, reach = self.levels[k], self.levels[-1] - self.levels[k]
            passed = among(windows_of(self.word, size), sets.get(k + 1, np.zeros(0, np.uint64)))
            for i in range(0, reach + 1):
                out = out & passed[i : i + len(out)]
        return out

    def at_level(self, level: int, sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes to look up at a level below the last one, and the number of the text of each."""
        if level == 0:
            at = np.unique(self.anchor[self.ok])
            return self.base[at], self.doc[at]
        of, reach = windows_of(self.word, self.levels[level]), self.levels[-1] - self.levels[level]
        start = np.flatnonzero(self.known(level, sets))
        at = np.unique((start[:, None] + np.arange(reach + 1)).ravel())
        return of[at], self.doc[at]


def _lookup(level: int, n: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(texts: pa.Table, info: pa.Table) -> pa.Table:
        _, raw, first, sets = table_of(texts, info)
        raw = list(compress(raw, first))
        hs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in pieces(raw):
            h, doc = _Windows(raw[i:j], n).at_level(level, sets)
            hs.append(h)
            docs.append(doc + i)
        h = once_or_twice(np.concatenate(hs), np.concatenate(docs))
        out = packs(spread(h, parts), {"h": h})
        b = int(texts.column("b")[0].as_py()) if texts.num_rows else 0
        return pa.table({"bucket": out["bucket"], "b": pa.array(np.full(len(out["bucket"]), b, np.int32)), "h": out["h"]})

    return find


def _last_level(raw: list[bytes], ids: list[int], n: int, sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that may repeat, each once: two hashes and the smallest doc_id."""
    cols: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    known = np.asarray(ids, np.int64)
    for i, j in pieces(raw):
        w = _Windows(raw[i:j], n)
        at = np.flatnonzero(w.known(len(w.levels) - 1, sets))
        for col, x in zip(cols, (windows_of(w.word, n)[at], windows_of(w.word, n, 7)[at], known[i:j][w.doc[at]]), strict=True):
            col.append(x)
    a, c, doc = (np.concatenate(x) for x in cols)
    at, _ = numbered_pairs(a, c)  # texts come by doc_id, so the first of equal ones has the smallest
    return a[at], c[at], doc[at]


def _earliest(n: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(texts: pa.Table, info: pa.Table) -> pa.Table:
        ids, raw, first, sets = table_of(texts, info)
        a, c, doc = _last_level(list(compress(raw, first)), list(compress(ids, first)), n, sets)
        out = packs(spread(a, parts), {"h": a, "g": c, "doc": doc})
        b = int(texts.column("b")[0].as_py()) if texts.num_rows else 0
        return pa.table({"bucket": out["bucket"], "b": pa.array(np.full(len(out["bucket"]), b, np.int32)), "h": out["h"], "g": out["g"], "doc": out["doc"]})

    return find


def _later(kind: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """INFO rows with the windows that start in a document before all of bucket b's own."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g, doc, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for x in batches:
            for bb, hh, gg, dd in zip(*(x.column(c).to_pylist() for c in ("b", "h", "g", "doc")), strict=True):
                h.append(np.frombuffer(hh, np.uint64))
                g.append(np.frombuffer(gg, np.uint64))
                doc.append(np.frombuffer(dd, np.int64))
                b.append(np.full(len(h[-1]), bb, np.int32))
        hs, gs, ds, bs = (np.concatenate(x) for x in (h, g, doc, b))
        order = np.lexsort((ds, gs, hs))
        hs, gs, ds, bs = hs[order], gs[order], ds[order], bs[order]
        if len(hs):
            new = np.ones(len(hs), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
            least = ds[np.flatnonzero(new)][np.cumsum(new) - 1]
            later = ds > least
            bs, hs, gs = bs[later], hs[later], gs[later]
        yield info_batch(bs, np.stack((hs, gs), 1).view("V16").ravel(), kind)

    return meet


def _marked(ids: list[int], raw: list[bytes], n: int, sets: dict[int, np.ndarray], kind: int) -> list[np.ndarray]:
    """Of each text, which words go."""
    found = []
    known = np.asarray(ids, np.int64)
    for i, j in pieces(raw):
        w = _Windows(raw[i:j], n)
        at = np.flatnonzero(w.known(len(w.levels) - 1, sets))
        found.append((j - i, w.doc, at, windows_of(w.word, n)[at], windows_of(w.word, n, 7)[at], known[i:j][w.doc[at]]))
    h, g = (np.concatenate([np.zeros(0, np.uint64)] + [x[k] for x in found]) for k in (3, 4))
    doc = np.concatenate([np.zeros(0, np.int64)] + [x[5] for x in found])
    first, number = numbered_pairs(h, g)
    gone = among_pairs(h, g, sets.get(kind, np.zeros(0, np.uint64)).reshape(-1, 2)) | (doc > doc[first][number])
    out, k = [], 0
    for texts, of, start, *_ in found:
        hit = start[gone[k : k + len(start)]]
        k += len(start)
        cover = np.zeros(len(of) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + n, -1)
        cover = np.cumsum(cover)[:-1] > 0
        ends = np.searchsorted(of, np.arange(texts + 1))
        out += [cover[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _kept(n: int, kind: int, digest: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut(texts: pa.Table, info: pa.Table) -> pa.Table:
        ids, raw, first, sets = table_of(texts, info)
        marks = iter(_marked(list(compress(ids, first)), list(compress(raw, first)), n, sets, kind))
        rows: dict[str, list] = {"doc_id": ids, "n_words": [], "n_removed": [], "kept": []}
        for i, t, one in zip(ids, raw, first, strict=True):
            words = t.split()
            if one:
                gone = next(marks)
                left = list(compress(words, (~gone).tolist())) if gone.any() else words
            else:  # a later copy: every window of it starts in the first copy
                left = words if i is None or len(words) < n else []
            kept = b" ".join(left)
            rows["n_words"].append(len(words))
            rows["n_removed"].append(len(words) - len(left))
            rows["kept"].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
        return pa.table(rows, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return cut


def substring_dedup(docs: DataFrame, n_words: int = N_WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of `docs` (doc_id, text): without each word that a window
    of n_words words covers which also starts in a document with a smaller doc_id; kept words joined by one space,
    or with `digest` their SHA-256. Windows are judged on the input. Null and empty texts have no words. Equal rows
    are copies of one document: none takes words from the other. Rows without doc_id stay whole and take nothing
    from others. Other columns are ignored. No rows in, none out."""
    n = partitions(docs)
    rows = bucketed(docs, 2 * n)
    groups = rows.groupBy("b")
    levels = levels_for(n_words)
    info = first_copies(rows)
    for k in range(len(levels) - 1):
        sent = groups.cogroup(info.groupBy("b")).applyInArrow(_lookup(k, n_words, n), "bucket int, b int, h binary")
        info = info.union(shared_by_two(sent, n, k + 1))
    last = groups.cogroup(info.groupBy("b")).applyInArrow(_earliest(n_words, n), "bucket int, b int, h binary, g binary, doc binary")
    info = info.union(last.repartitionById(n, "bucket").mapInArrow(_later(99), INFO))
    return groups.cogroup(info.groupBy("b")).applyInArrow(_kept(n_words, 99, digest), RESULT)


def op5_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, N_WORDS, digest=True).withColumnRenamed("kept", "kept_sha256")


OP5_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
least AS (SELECT k, min(doc_id) AS first FROM wins GROUP BY k),
hits AS (SELECT doc_id, i FROM wins JOIN least USING (k) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hits),
each AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT e.doc_id, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""
