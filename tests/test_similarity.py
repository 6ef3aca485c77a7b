"""Products of blocks against all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import relational as rel
from curatrix.operators import similarity

EDGES = [0.0, 0.5, 0.9, 1.0]


def vectors():
    rng = np.random.default_rng(3)
    some = rng.normal(size=(60, 5)) + 1
    some[7] = some[3]
    some[11] = 0
    some[12] = -some[3]
    return [(100 * k, [float(np.float32(c)) for c in v]) for k, v in enumerate(some)]


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return round(float(a @ b / ((np.sqrt(a @ a) or 1) * (np.sqrt(b @ b) or 1))), 9)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([*vectors(), (1, None), (2, []), (3, [1.0, None, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("block", [7, 1000])
def test_counts_of_all_pairs(frame, block):
    want = [0] * 3
    for (_, a), (_, b) in itertools.combinations(vectors(), 2):
        for k in range(3):
            want[k] += EDGES[k] <= cosine(a, b) < EDGES[k + 1]
    for ordered in (False, True):
        got = similarity.pair_counts(frame, EDGES, ordered, block, 4).orderBy("bin").collect()
        assert [r.n for r in got] == [n * (1 + ordered) for n in want] and [r.low for r in got] == EDGES[:-1]
    assert [r.n for r in similarity.pair_counts(frame.limit(0), EDGES).collect()] == [0, 0, 0]


def test_what_travels_grows_as_the_rows_do(spark, monkeypatch):
    dealt, grid = [], similarity.in_grid
    monkeypatch.setattr(similarity, "in_grid", lambda rows, key, blocks: dealt.append(blocks) or grid(rows, key, blocks))
    rows = lambda n: spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"))
    for n in (60, 240):
        assert sum(r.n for r in similarity.pair_counts(rows(n), [-2.0, 0.0, 2.0], block=2).collect()) == n * (n - 1) // 2
    assert dealt[0] == dealt[1] < 10
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 1 << 6)  # blocks stay within it: 60 vectors of 16 bytes each
    similarity.pair_counts(rows(60), [-2.0, 0.0, 2.0], block=2)
    assert dealt[2] == 15


@pytest.mark.parametrize("block", [5, 1000])
def test_probes(frame, block):
    probes = frame.where("vec_id % 500 = 0 or vec_id in (1, 300)")
    got = {(r.probe, r.vec_id): r.similarity for r in similarity.over_threshold(probes, frame, 0.4, block, 3).collect()}
    want = {(i, k): cosine(a, b) for i, a in vectors() if i % 500 == 0 or i == 300 for k, b in vectors() if i != k and cosine(a, b) > 0.4}
    assert got == want
    assert similarity.over_threshold(probes.limit(0), frame, 0.4).count() == 0


def test_pairs_of_values(spark):
    rows = spark.createDataFrame([("abc"[k % 3] + "xyzuvw"[k % 6], k) for k in range(40)], "v string, pos int")
    first = {}
    for k in range(40):
        first.setdefault("abc"[k % 3] + "xyzuvw"[k % 6], k)
    want = sorted((a, b) for a in first for b in first if first[a] < first[b])
    assert sorted(map(tuple, rel.value_pairs(rows, "v", "pos").collect())) == want
    grid = similarity.grid_pairs(rows, "pos", F.col("a.pos") < F.col("b.pos"), 7)
    assert grid.count() == 40 * 39 // 2 and "NestedLoop" not in grid._jdf.queryExecution().toString()
