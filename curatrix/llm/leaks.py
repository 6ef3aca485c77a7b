"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items meet on seeds, runs of TILE tokens, the shortest that can be a tile. An item covered to
`coverage` has at least coverage * length / TILE of its runs in the text, so of its rarest runs, all but so many less
one, the text holds one: these are its seeds, and a phrase that many items share joins none of them by itself. The
share of an item's tokens that lie in shared runs bounds what tiles can cover; items whose bound reaches `coverage`
are tiled, in order of this bound, until no further one can cover more than the best so far.

Greedy string tiling marks the longest match of tokens that neither side has marked yet, again and again, down to
TILE tokens; running Karp-Rabin finds the matches of a search length. An item leaked if the tiles cover enough of its
tokens, in whatever order they stand, so passages that were cut up and reordered count. Where a script sets no spaces
between words, each character is a token.

The benchmark goes to the tasks in blocks of a checked size, one pass over the texts each; the driver holds one block
at a time. A pass writes the leaks it found, by hash of the text, and these are joined to the documents at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import among, chunks, joined, pieces, powers, slices, windows_of, words_of, written

TILE = 3
COVERAGE = 0.6
BLOCK_BYTES = 8 << 20
PAIRS = 1 << 18  # pairs worked on at once
_PUNCTUATION = re.compile(r"[\W_]+")
#: Letters of scripts without spaces between words: Thai to Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_ASCII = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def token_text(text: str) -> bytes:
    """Lower case, with white space for all that is neither a letter nor a digit, and around unspaced letters."""
    text = text.lower()
    return text.encode().translate(_ASCII) if text.isascii() else _UNSPACED.sub(r" \g<0> ", _PUNCTUATION.sub(" ", text)).encode()


def tokens(text: str) -> np.ndarray:
    return words_of(token_text(text))[2]


class _Rolling:
    """Karp-Rabin hashes of the runs of a sequence: prefix sums of a polynomial, so that those of any length follow
    from one another by a subtraction."""

    def __init__(self, x: np.ndarray) -> None:
        power, self.inverse = powers(len(x) + 1)
        self.x, self.free = x, np.ones(len(x), bool)
        self.total = np.zeros(len(x) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(x * power[:-1], out=self.total[1:])

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the runs of `size` unmarked tokens."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        start = np.flatnonzero(taken[size:] == taken[: max(0, len(taken) - size)])
        with np.errstate(over="ignore"):
            return start, (self.total[start + size] - self.total[start]) * self.inverse[start]


def _matches(a: _Rolling, b: _Rolling, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the unmarked equal runs of `size` or more tokens that no token before or
    after them makes longer. Runs of equal hash are compared token by token."""
    i, ha = a.runs(size)
    j, hb = b.runs(size)
    order = np.argsort(hb, kind="stable")
    hb, j = hb[order], j[order]
    low, high = np.searchsorted(hb, ha), np.searchsorted(hb, ha, "right")
    n, found = high - low, [np.zeros((3, 0), np.int64)]
    for at, to in chunks(n, PAIRS):
        m = n[at:to]
        x = np.repeat(i[at:to], m)
        y = j[np.arange(len(x)) - np.repeat(np.cumsum(m) - m - low[at:to], m)]
        starts = (x == 0) | (y == 0)
        starts |= ~(a.free[x - 1] & b.free[y - 1] & (a.x[x - 1] == b.x[y - 1]))
        x, y = x[starts], y[starts]
        k, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live):
            p, q = x[live] + k[live], y[live] + k[live]
            inside = (p < len(a.x)) & (q < len(b.x))
            live, p, q = live[inside], p[inside], q[inside]
            live = live[(a.x[p] == b.x[q]) & a.free[p] & b.free[q]]
            k[live] += 1
        found.append(np.stack((x, y, k))[:, k >= size])
    return tuple(np.concatenate(found, 1))


def tile(x: np.ndarray, y: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in x, start in y, length) of non-overlapping equal runs of `least` or more
    tokens, longest first; of equally long ones the one that starts first in x, then in y."""
    a, b = _Rolling(np.asarray(x, np.uint64)), _Rolling(np.asarray(y, np.uint64))
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(x), len(y)) // 2)
    while True:
        i, j, k = _matches(a, b, size)
        if len(k) and k.max() > 2 * size:
            size = int(k.max())
            continue
        redo = False
        for t in np.lexsort((j, i, -k)).tolist():
            p, q, n = int(i[t]), int(j[t]), int(k[t])
            if a.free[p : p + n].all() and b.free[q : q + n].all():
                a.free[p : p + n] = b.free[q : q + n] = False
                tiles.append((p, q, n))
            else:
                redo = True  # part of it is taken; what is left may still be long enough
        if redo:
            continue
        if size <= least:
            return tiles
        size = max(least, size // 2)


class Benchmark:
    """A block of items: their tokens and runs, and the seeds with the item of each."""

    def __init__(self, rows: list[tuple[int, str]], coverage: float = COVERAGE, least: int = TILE) -> None:
        self.least, self.coverage, self.ids, self.tokens = least, coverage, [], []
        runs = [np.zeros(0, np.uint64)]
        for item, text in rows:
            t = tokens(text)
            if len(t) < least:
                continue
            runs.append(windows_of(t, least))
            self.ids.append(item)
            self.tokens.append(t)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        n = np.maximum(0, self.size - least + 1)
        self.known, self.run, count = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
        self.first = np.cumsum(n) - n  # where the runs of each item begin
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((self.run, count[self.run], of))  # the rarest of each item first
        spare = np.maximum(1, np.ceil(coverage * self.size / least - 1e-9).astype(np.int64)) - 1
        use = np.arange(len(of)) - self.first[of] < (n - spare)[of]
        order = order[use]
        order = order[np.lexsort((of[order], self.run[order]))]
        self.seed, self.of = self.run[order], of[order]

    def leaks(self, texts: list[str]) -> list[tuple[int, float, int] | None]:
        """For each text its item of greatest coverage, of those the smallest: (item_id, coverage, tiles)."""
        out: list[tuple[int, float, int] | None] = [None] * len(texts)
        data, at = joined([token_text(t) for t in texts])
        start, _, word = words_of(data)
        doc = np.searchsorted(at, start, "right") - 1
        begin = np.searchsorted(doc, np.arange(len(texts) + 1))
        h = windows_of(word, self.least)
        place = np.flatnonzero(doc[: len(h)] == doc[self.least - 1 :]) if len(h) else np.zeros(0, np.int64)
        if not len(place) or not len(self.known):
            return out
        run = np.minimum(np.searchsorted(self.known, h[place]), len(self.known) - 1)
        same = self.known[run] == h[place]
        place, run = place[same], run[same]
        pair = np.unique(doc[place] * len(self.known) + run)  # (text, run), each once
        text = pair // len(self.known)
        met = np.searchsorted(self.seed, pair % len(self.known), "right") - np.searchsorted(self.seed, pair % len(self.known))
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        met = np.concatenate(([0], np.cumsum(met)))[ends]
        for i, j in chunks(np.diff(met), PAIRS):  # of texts
            self._candidates(pair[ends[i] : ends[j]], word, begin, place, run, out)
        return out

    def _candidates(self, pair: np.ndarray, word: np.ndarray, begin: np.ndarray, place: np.ndarray, run: np.ndarray, out: list) -> None:
        """Fills `out` for the texts of `pair`: each the number of a text and of a run that it holds."""
        runs = len(self.known)
        low = np.searchsorted(self.seed, pair % runs)
        n = np.searchsorted(self.seed, pair % runs, "right") - low
        row = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.unique(np.repeat(pair // runs, n) * len(self.size) + self.of[row])
        for k, z in chunks((self.size - self.least + 1)[both % len(self.size)], PAIRS):
            text, item = np.divmod(both[k:z], len(self.size))
            n = self.size[item] - self.least + 1
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = np.repeat(text, n) * runs + self.run[np.repeat(self.first[item], n) + inner]
            hit = np.flatnonzero(among(key, pair))
            of = np.repeat(np.arange(len(item)), n)[hit]
            fresh = np.minimum(np.diff(inner[hit], prepend=0), self.least)  # tokens of the item in no shared run before
            heads = np.flatnonzero(np.diff(of, prepend=-1))
            fresh[heads] = self.least
            bound = np.bincount(of, fresh, len(item)) / self.size[item]
            may = np.flatnonzero(bound >= self.coverage)
            for t in may[np.lexsort((np.array(self.ids)[item[may]], -bound[may], text[may]))].tolist():
                d, i, best = int(text[t]), int(item[t]), out[int(text[t])]
                if best and (-bound[t], self.ids[i]) >= (-best[1], best[0]):
                    continue
                mine = slice(*np.searchsorted(place, begin[d : d + 2]))
                tiles = tile(self.tokens[i], self._near(i, word[begin[d] : begin[d + 1]], place[mine] - begin[d], run[mine]), self.least)
                got = (self.ids[i], sum(z for _, _, z in tiles) / int(self.size[i]), len(tiles))
                if got[1] >= self.coverage and (best is None or (-got[1], got[0]) < (-best[1], best[0])):
                    out[d] = got

    def _near(self, i: int, word: np.ndarray, place: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The tokens of a text in runs that item i has too, with a gap, a token of no item, after each stretch."""
        p = place[np.isin(run, self.run[self.first[i] : self.first[i] + int(self.size[i]) - self.least + 1])]
        near = np.zeros(len(word) + 1, bool)
        for j in range(self.least):
            near[p + j] = True
        ends = np.concatenate(([False], near[:-1] & ~near[1:]))
        return np.where(near, np.append(word, np.uint64(0)), np.uint64(0))[near | ends]


FOUND = "leak_key string, leak_item long, leak_coverage double, leak_tiles long"


def leaking(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(leak_key, leak_item, leak_coverage, leak_tiles): for each distinct text of `docs`, by its MD5, of which an
    item is covered to `coverage`, the item covered most, of equal ones the smallest. Null items and items of fewer
    than TILE tokens are no items, nor are rows without item_id."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    texts = docs.where("text is not null").select(F.md5("text").alias("leak_key"), F.col("text").alias("leak_text"))
    found = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(sorted((r.item_id, r.text) for r in block.distinct().collect()), coverage))
        part = written(texts.mapInArrow(_look_up(sent), FOUND), "leaks")  # the block is done with now
        sent.destroy()
        found = part if found is None else found.union(part)
    best = F.min(F.struct((-F.col("leak_coverage")).alias("c"), "leak_item", "leak_tiles")).alias("r")
    best = found.groupBy("leak_key").agg(best).select("leak_key", "r.leak_item", (-F.col("r.c")).alias("leak_coverage"), "r.leak_tiles")
    return written(best, "leaks")  # its size is known from now on, so Spark broadcasts it only if it is small


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with leak_item (see leaking(); null if none is covered), leak_coverage (its covered share; 0 if none)
    and leak_tiles. Columns of these names are replaced; the others stay. Null and empty texts leak nothing. Repeated
    rows get equal results, and texts of any length are looked at whole. No rows in, none out; an empty benchmark
    leaks nowhere."""
    docs = docs.drop("leak_item", "leak_coverage", "leak_tiles")
    best = leaking(docs, benchmark, coverage, block_bytes)
    rows = docs.join(best, F.md5(docs["text"]) == best["leak_key"], "left")
    return rows.select(*[docs[c] for c in docs.columns], best["leak_item"], F.coalesce(best["leak_coverage"], F.lit(0.0)).alias("leak_coverage"), F.coalesce(best["leak_tiles"], F.lit(0).cast("long")).alias("leak_tiles"))


def _look_up(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for x in slices(batches):
            text, key = x.column("leak_text").to_pylist(), x.column("leak_key")
            for i, j in pieces(text):
                got = [(k, *g) for k, g in enumerate(block.leaks(text[i:j]), i) if g]
                if got:
                    at, *cols = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64()), strict=True))], [c.split()[0] for c in FOUND.split(", ")])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs` of whose text no item is covered to `coverage` or more, with all their columns."""
    best = leaking(docs, benchmark, coverage)
    return docs.join(best, F.md5(docs["text"]) == best["leak_key"], "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", F.col("leak_item").isNotNull().alias("contaminated"), F.col("leak_item").alias("item_id"), F.col("leak_coverage").alias("coverage"), F.col("leak_tiles").alias("n_tiles"))
