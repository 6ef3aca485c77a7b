"""Substring, suffix-array, Jaccard and embedding dedup against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import embeddings, jaccard, substring, suffix
from tests.llm.conftest import texts

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, n):
    first = {}
    docs = [(i, SPACE.findall(t or "")) for i, t in rows]
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k : k + n])] < i:
                    gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 5, 13, 29])
def test_substring(docs, n):
    got = [tuple(r) for r in substring.substring_dedup(docs, n, digest=True).collect()]
    assert sorted(got, key=str) == brute_words(texts(), n)


def test_levels_are_scanned_and_merged(monkeypatch):
    """A shard of usual size makes several batches; their levels are scanned and merge, and mark what brute force marks."""
    rng, done = np.random.default_rng(4), {"scan": 0, "merged": 0}
    for name in done:
        def counted(self, other, name=name, work=getattr(suffix._Level, name)):
            done[name] += 1
            return work(self, other)

        monkeypatch.setattr(suffix._Level, name, counted)
    parts = [bytes(rng.integers(97, 101, 400, np.uint8)) for _ in range(60)]
    texts = [b"".join(parts[k] for k in rng.integers(0, 60, 5)) + bytes(rng.integers(97, 123, 300, np.uint8)) for _ in range(150)]
    order = rng.permutation(len(texts)).tolist()
    number = lambda x, kind: np.array(x, kind).tobytes()
    rows = [(number([k % 40 for k in some], np.uint64), number(some, np.int64), number([0] * len(some), np.int64), number([len(texts[k]) - 99 for k in some], np.int32), b"".join(texts[k] for k in some)) for some in (order[:70], order[70:])]
    got = {(d, s + i) for runs in suffix._shard(rows, 100, suffix.BATCH_BYTES) for d, s, n in zip(*(x.tolist() for x in runs), strict=True) for i in range(n)}
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for i in range(len(t) - 99):
            (want.add((d, i)) if t[i : i + 100] in seen else seen.add(t[i : i + 100]))
    assert got == want and done["merged"] >= 5 and done["scan"] >= 10


def test_levels():
    assert substring.levels_for(13) == [7, 13] and substring.levels_for(1) == [1] and substring.levels_for(50) == [7, 13, 25, 50]


def brute_bytes(rows, n):
    docs = sorted({(i, (t or "").encode()) for i, t in rows if i is not None})
    seen, cut = set(), {}
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            if s in seen:
                gone[k : k + n] = True
            seen.add(s)
        cut[i] = gone
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = cut[i] if i is not None else np.zeros(len(b), bool)
        spans = sum(1 for k, _ in itertools.groupby(gone.tolist()) if k)
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [20, 37, 100])
def test_suffix(docs, n):
    got = [tuple(r)[:4] + (bytes(r.kept),) for r in suffix.suffix_dedup(docs, n, batch_bytes=2000).collect()]
    assert sorted(got, key=str) == brute_bytes(texts(), n)


def brute_sets(rows, words, percent):
    sets = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = SPACE.findall(low)
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()))
    part = {i: i for i, _ in sets}
    links = [0] * len(sets)
    pairs = []
    for (a, (i, s)), (b, (j, r)) in itertools.combinations(enumerate(sets), 2):
        if i is not None and j is not None and s and r and 100 * len(s & r) >= percent * len(s | r):
            links[a] += 1
            links[b] += 1
            pairs.append((i, j))
    for _ in sets:
        for i, j in pairs:
            part[i] = part[j] = min(part[i], part[j])
    return sorted(((i, len(s), part[i], n) for (i, s), n in zip(sets, links, strict=True)), key=str)


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 50), (1, 70)])
def test_jaccard(docs, words, percent):
    got = [tuple(r) for r in jaccard.jaccard_join(docs, words, percent).collect()]
    assert sorted(got, key=str) == brute_sets(texts(), words, percent)


def test_jaccard_in_blocks(spark, monkeypatch):
    """A cluster over several blocks of several size bands gives what brute force gives."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(70):
        w = base.copy()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    rows += [(100 + i, " ".join(base[: 40 + i % 20] + [f"y{i % 7}"])) for i in range(40)]  # sets of several size bands
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name, limit in (("BLOCK", 16), ("ELEMENTS", 900)):
        with monkeypatch.context() as m:
            m.setattr(jaccard, name, limit)
            for words, percent in ((3, 90), (5, 80)):
                assert sorted(map(tuple, jaccard.jaccard_join(frame, words, percent).collect())) == sorted(brute_sets(rows, words, percent))


def test_jaccard_of_long_texts_in_one_cluster(spark):
    """Texts of which few fill a block: near copies of several hundred thousand words each."""
    rows = spark.range(8).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 300000), i -> concat('w', if(i % 50000 = id + 1, 'x', ''), i)))").alias("text"))
    got = {r.doc_id: r for r in jaccard.jaccard_join(rows, 3, 90).collect()}
    assert {r.component_id for r in got.values()} == {0} and {r.n_links for r in got.values()} == {7} and {r.n_shingles for r in got.values()} == {299998}


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 10, 19, 20, 57, 300):
        for percent in (80, 90):
            a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
            for gone in range(n + 1):
                b = a[gone:]
                if 100 * len(b) < percent * n or not len(b):
                    break
                doc = np.repeat([0, 1], [len(a), len(b)])
                of, sig = jaccard.signatures(doc, np.concatenate((a, b)), 2, percent)
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_signatures_at_the_threshold():
    """Pairs with as many differences as the similarity allows, in sets of the sizes that leave signatures out."""
    rng = np.random.default_rng(2)
    for n in (45, 50, 54, 60, 90, 120, 135, 150, 200):
        common = n * 80 // 90
        for _ in range(300):
            x = rng.choice(1 << 62, 2 * n - common, replace=False).astype(np.uint64)
            a, b = x[:n], np.concatenate((x[:common], x[n:]))
            of, sig = jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), 2, 80)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), n


def vectors(d=16):
    rng = np.random.default_rng(5)
    out = []
    for i in range(300):
        v = rng.normal(size=d)
        out.append([float(x) for x in v])
        if i % 3 == 0:
            out.append([float(x) for x in v + rng.normal(size=d) * 0.05])
        if i % 10 == 0:
            out += [[float(x) for x in v]] * 2
    out += [None, [], [0.0] * d, [math.nan] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [math.inf] * d, [1.0] * (d + 1), [2.0] * (d + 1)]
    return list(enumerate(out))


def test_embeddings(spark):
    rows = vectors()
    frame = spark.createDataFrame([*rows, (None, [1.0] * 16)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links, part, found, missed, total = dict.fromkeys(got, 0), {i: i for i, _ in rows}, 0, 0, []
    for (i, a), (j, b) in itertools.combinations(good, 2):
        if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95:
            links[i] += 1
            links[j] += 1
            total.append((i, j))
    for _ in range(20):
        for i, j in total:
            part[i] = part[j] = min(part[i], part[j])
    assert got[None] == (0, None, False) or got[None] == (0, None, True)
    assert {i: got[i][0] for i in got} == links  # none missed, as measured
    assert {i: got[i][1] for i in part} == part
    assert all(got[i][2] == (got[i][1] == i) for i in part)


def test_embeddings_with_repeated_ids_and_of_any_size(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.5, -0.5, -1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (4, c), (5, [1e200 * x for x in c]), (6, [1e-200 * x for x in c]), (7, [5e-324, 0.0, 0.0]), (8, [1e308, 0.0, 0.0]), (9, [0.0, 0.0, 0.0]), (10, None), (10, c)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    links = {k: 0 for k in range(len(rows))}
    unit = [None if v is None or not any(v) else np.array(v) / np.abs(v).max() for _, v in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if unit[i] is not None and unit[j] is not None and unit[i] @ unit[j] / math.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= 0.95]
    name = [i for i, _ in rows]
    for _ in rows:
        for i, j in pairs:
            name[i] = name[j] = min(name[i], name[j])
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    assert got == sorted((rows[k][0], links[k], name[k], rows[k][0] == name[k]) for k in range(len(rows)))
    assert (3, 1, 1, False) in got and (6, 4, 4, False) in got


def test_embeddings_in_blocks(spark, monkeypatch):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, embeddings.near_duplicates(frame).collect()))
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    assert sorted(map(tuple, embeddings.near_duplicates(frame).collect())) == whole


def test_recall_is_calibrated():
    t, tables, width = embeddings.tables_for(10_000)
    near = embeddings._same_cell(math.sqrt(0.1) / width)
    assert 1 - (1 - near**t) ** tables >= embeddings.RECALL
    assert 20 <= embeddings.least_count() <= 40


def test_empty_tables(spark, none):
    assert substring.substring_dedup(none).count() == 0
    assert suffix.suffix_dedup(none).count() == 0
    assert jaccard.jaccard_join(none).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
