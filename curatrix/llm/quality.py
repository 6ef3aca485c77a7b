"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words, hashed, weighted by the logarithm of their counts and scaled to length one; statistics
of its structure, each as the interval it falls in; and its length. Each feature has a weight and FACTORS numbers;
a pair of features interacts by the product of theirs. The sum over all pairs is, per factor, half the difference
between the squared sum and the sum of squares, so a text is scored in time linear in its features.

The machine is fitted to at most SAMPLE labelled rows, by hash of their id; all rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import SLICE, joined, pieces, slices, words_of, written
from curatrix.llm.mixing import unit_hash

SAMPLE = 8000
WORD_BITS = 12
FACTORS = 8
BINS = 16
EPOCHS = 14
STEPS = 900  # at least, where rows are few
THRESHOLD = 0.3
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower case, 2 upper case, 3 digit, 4 stop or comma, 5 other ASCII symbol, 6 space
for _c in range(33, 127):
    _KIND[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if chr(_c) in ".,;:'\"-" else 5
_KIND[[9, 10, 11, 12, 13, 32]] = 6
SPAN = 64  # words to a stretch

STATISTICS = (
    "log_bytes", "log_words", "upper", "digit", "stop", "symbol", "other", "word_length", "long_words", "distinct", "top_word", "repeated_next", "symbol_words", "upper_words",
    "log_lines", "line_words", "repeated_lines", "worst_symbols", "worst_upper", "worst_distinct", "worst_repeat", "repeated_tens",
)


def _share(of: np.ndarray, base: np.ndarray) -> np.ndarray:
    return of / np.maximum(base, 1)


def _repeated(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """By text, how many of its hashes are repeats; hashes count by their upper 40 bits."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    return np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics by text, and (text, word bucket, weight) of the words."""
    n = len(texts)
    data, at = joined(texts)
    raw = np.frombuffer(data, np.uint8)
    start, end, word = words_of(data)
    doc = np.searchsorted(at, start, "right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    size = np.fromiter((len(t) for t in texts), float, n)
    kind = _KIND[raw]
    by_word = {}
    for k, name in ((2, "upper"), (3, "digit"), (4, "stop"), (5, "symbol"), (0, "other")):
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        by_word[name] = total[end] - total[start]
    length = (end - start).astype(float)
    s: dict[str, np.ndarray] = {"log_bytes": np.log1p(size), "log_words": np.log1p(words)}
    letters = np.bincount(doc, length, n)
    for k, v in by_word.items():
        s[k] = _share(np.bincount(doc, v, n), letters)
    s["word_length"] = _share(letters, words)
    s["long_words"] = _share(np.bincount(doc, length > 20, n), words)
    bucket = (word >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    keys, first, count = np.unique((doc.astype(np.int64) << WORD_BITS) | bucket, return_index=True, return_counts=True)
    owner = keys >> WORD_BITS
    s["distinct"] = 1 - _share(_repeated(doc, word, n), words)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    s["top_word"] = _share(top, words)
    same = np.zeros(len(doc), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    s["repeated_next"] = _share(np.bincount(doc, same, n), words)
    symbols, upper = by_word["symbol"] > 0, by_word["upper"] * 2 > length
    s["symbol_words"], s["upper_words"] = _share(np.bincount(doc, symbols, n), words), _share(np.bincount(doc, upper, n), words)
    gaps = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=gaps[1:])
    line = gaps[start]  # number of the line of each word; a text starts a new one
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    begin = np.flatnonzero(new)
    lines = np.bincount(doc[begin], minlength=n).astype(float)
    s["log_lines"], s["line_words"] = np.log1p(lines), np.log1p(_share(words, lines))
    mixed = (word ^ (word << np.uint64(13))) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.add.reduceat(mixed, begin) if len(begin) else mixed
    s["repeated_lines"] = _share(_repeated(doc[begin], sums, n), lines)
    # the worst stretch of SPAN words: junk may fill just a part of a long text
    first_word = np.searchsorted(doc, np.arange(n + 1))
    inner = np.arange(len(doc)) - first_word[doc]
    stretch = np.searchsorted(np.flatnonzero((inner % SPAN == 0)), np.arange(len(doc)), "right") - 1
    opens = np.flatnonzero(inner % SPAN == 0)
    of, in_stretch = doc[opens], np.bincount(stretch, minlength=len(opens)).astype(float) if len(opens) else np.zeros(0)
    full = np.maximum(in_stretch, SPAN / 2)
    for name, v in (("worst_symbols", symbols), ("worst_upper", upper), ("worst_repeat", same)):
        worst = np.zeros(n)
        if len(opens):
            np.maximum.at(worst, of, np.bincount(stretch, v, len(opens)) / full)
        s[name] = worst
    worst = np.zeros(n)
    if len(opens):
        np.maximum.at(worst, of, _repeated(stretch, word, len(opens)) / full)
    s["worst_distinct"] = worst
    tens = word[: max(0, len(word) - 9)].copy()
    for k in range(1, 10):
        tens = (tens * np.uint64(0xD6E8FEB86659FD93)) ^ word[k : len(word) - 9 + k] if len(tens) else tens
    ok = doc[: len(tens)] == doc[9:] if len(tens) else np.zeros(0, bool)
    s["repeated_tens"] = _share(_repeated(doc[: len(tens)][ok], tens[ok], n), words)
    weight = np.log1p(count)
    weight /= np.sqrt(np.bincount(owner, weight**2, n))[owner]
    return np.stack([s[k] for k in STATISTICS], 1), owner, keys & ((1 << WORD_BITS) - 1), weight


class Machine:
    """Weights and factors; features are word buckets, then for each statistic its BINS intervals."""

    def __init__(self, edges: np.ndarray, seed: int = 1) -> None:
        self.edges = edges  # (statistics, BINS - 1)
        size = (1 << WORD_BITS) + len(STATISTICS) * BINS
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bias, self.weight = 0.0, np.zeros(size)
        self.factor = rng.normal(0, 0.05, (size, FACTORS))

    def features(self, stats: np.ndarray, doc: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value), by text."""
        rows = [np.searchsorted(self.edges[k], stats[:, k], "right") + (1 << WORD_BITS) + k * BINS for k in range(len(STATISTICS))]
        d = np.concatenate([doc, *[np.arange(len(stats))] * len(STATISTICS)])
        f = np.concatenate([bucket, *rows])
        x = np.concatenate([weight, np.ones(len(stats) * len(STATISTICS)) / np.sqrt(len(STATISTICS))])
        order = np.argsort(d, kind="stable")
        return d[order], f[order], x[order]

    def raw(self, d: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function, and the factor sums."""
        begin = np.searchsorted(d, np.arange(n))  # each text has its statistics, so none is without features
        v = self.factor[f] * x[:, None]
        sums = np.add.reduceat(v, begin, 0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(v**2, begin, 0)).sum(1)
        return self.bias + np.add.reduceat(self.weight[f] * x, begin) + pairs, sums

    def scores(self, texts: list[bytes]) -> np.ndarray:
        d, f, x = self.features(*describe(texts))
        return 1 / (1 + np.exp(-np.clip(self.raw(d, f, x, len(texts))[0], -30, 30)))

    def fit(self, d: np.ndarray, f: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-5, batch: int = 128, seed: int = 2) -> None:
        """Adagrad on the logistic loss, in batches in an order that the seed decides."""
        rng = np.random.Generator(np.random.PCG64(seed))
        begin = np.searchsorted(d, np.arange(len(y) + 1))
        grad_w, grad_v, grad_b = np.full_like(self.weight, 1e-2), np.full_like(self.factor, 1e-2), 1e-2
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        for _ in range(max(epochs, -(-STEPS // -(-len(y) // batch)))):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                rows = order[s : s + batch]
                count = begin[rows + 1] - begin[rows]
                at = np.repeat(begin[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
                dd, ff, xx = np.repeat(np.arange(len(rows)), count), f[at], x[at]
                z, sums = self.raw(dd, ff, xx, len(rows))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows) * batch / 16
                g, size = err[dd] * xx, len(self.weight)
                gw, square = np.bincount(ff, g, size), np.bincount(ff, g * xx, size)
                seen = gw != 0  # of the features that the batch doesn't have the gradient is none
                gv = np.stack([np.bincount(ff, g * sums[dd, k], size) for k in range(FACTORS)], 1) - square[:, None] * self.factor
                gw, gv, gb = gw + decay * self.weight * seen, gv + decay * self.factor * seen[:, None], err.sum()
                grad_w += gw**2
                grad_v += gv**2
                grad_b += gb**2
                self.weight -= rate * gw / np.sqrt(grad_w)
                self.factor -= rate * gv / np.sqrt(grad_v)
                self.bias -= rate * gb / np.sqrt(grad_b)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in slices(batches):
        raw = [t or b"" for t in x.column("text").cast(pa.binary()).to_pylist()]
        stats, words, weights = [], [], []
        for i, j in pieces(raw):
            s, owner, bucket, weight = describe(raw[i:j])
            stats += [r.tobytes() for r in s.astype(np.float32)]
            ends = np.searchsorted(owner, np.arange(1, j - i))
            words += [w.tobytes() for w in np.split(bucket.astype(np.int16), ends)]
            weights += [w.tobytes() for w in np.split(weight.astype(np.float32), ends)]
        yield pa.RecordBatch.from_arrays([x.column("quality"), *(pa.array(c, pa.binary()) for c in (stats, words, weights))], ["quality", "stats", "words", "weights"])


def train(labelled: DataFrame) -> Machine:
    """A machine fitted to rows (text, quality). Without rows, or with one label only, it scores all texts alike."""
    rows = labelled.mapInArrow(_described, "quality int, stats binary, words binary, weights binary").orderBy("stats", "words", "quality").collect()
    if not rows:
        return Machine(np.zeros((len(STATISTICS), BINS - 1)))
    stats = np.stack([np.frombuffer(r.stats, np.float32) for r in rows]).astype(float)
    machine = Machine(np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T)
    bucket = [np.frombuffer(r.words, np.int16).astype(np.int64) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(b) for b in bucket])
    weight = np.concatenate([np.frombuffer(r.weights, np.float32) for r in rows]).astype(float)
    d, f, x = machine.features(stats, doc, np.concatenate(bucket), weight)
    machine.fit(d, f, x, np.array([r.quality for r in rows], float))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` with quality_score, 0 to 1, from `text` alone; a column of this name is replaced, the others stay.
    Null texts score as empty ones; equal texts score alike. No rows in, none out."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(text: pa.Array) -> pa.Array:
        got = [np.zeros(0)]
        for at in range(0, len(text), SLICE):
            raw = [t or b"" for t in text.slice(at, SLICE).cast(pa.binary()).to_pylist()]
            got += [sent.value.scores(raw[i:j]) for i, j in pieces(raw)]
        return pa.array(np.concatenate(got))

    scores = F.arrow_udf(run, "double").asNondeterministic()  # or a filter on its result would run it once more
    return docs.drop("quality_score").withColumn("quality_score", scores("text"))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    share = SAMPLE / max(SAMPLE, labels.count())
    some = written(labels.where(unit_hash(F.col("doc_id"), "fm") < share).select("doc_id", "quality"), "labels")
    machine = train(docs.join(some, "doc_id").select("text", F.col("quality").cast("int").alias("quality")))
    out = score(docs, machine)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
