"""Suppression, components and alignment against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from curatrix.functions import vector as v
from curatrix.functions import align, scorers
from curatrix.functions import boxes as bx
from curatrix.operators import vision


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union else 0.0


def boxes(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((i // 20, i, rng.choice([0.1, 0.5, 0.9, rng.random()]), float(x), float(y), float(x + rng.randint(0, 40)), float(y + rng.randint(1, 40)), rng.choice("ab")))
    return rows, spark.createDataFrame(rows, "image_id int, box_id int, score double, x0 double, y0 double, x1 double, y1 double, cls string")


def test_suppressed(spark):
    rows, frame = boxes(spark)
    for by_class in (None, "cls"):
        want = set()
        for image in {r[0] for r in rows}:
            kept = []
            for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1])):
                if not any(iou(k[3:7], r[3:7]) > 0.3 and (by_class is None or k[7] == r[7]) for k in kept):
                    kept.append(r)
            want |= set(kept)
        assert {tuple(r) for r in vision.suppressed(frame, "image_id", 0.3, by_class).collect()} == want
    assert vision.suppressed(frame.limit(0), "image_id").count() == 0


def test_softly_suppressed(spark):
    rows, frame = boxes(spark)
    for gaussian in (False, True):
        want = {}
        for image in {r[0] for r in rows}:
            left = {r[1]: [r[2], r[3:7]] for r in rows if r[0] == image}
            while left:
                top = min(left, key=lambda k: (-left[k][0], k))
                score, box = left.pop(top)
                want[top] = score
                for k in list(left):
                    o = iou(box, left[k][1])
                    left[k][0] *= math.exp(-o * o / 0.5) if gaussian else 1 - o if o > 0.3 else 1
                    if left[k][0] <= 0.05:
                        del left[k]
        got = {r.box_id: r.score for r in vision.softly_suppressed(frame, "image_id", least=0.05, gaussian=gaussian).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_softly_suppressed_groups_of_all_sizes(spark):
    """Against a loop: nulls and NaN, a group of hundreds, names as ids; and no box is a step of an interpreted lambda."""
    rng, rows = random.Random(5), []
    for image in range(120):
        for k in range(300 if image == 7 else rng.choice([1, 1, 2, 3, 5, 9, 17])):
            x, y = rng.randint(0, 30), rng.randint(0, 30)
            box = [float(x), float(y), float(x + rng.randint(0, 40)), float(y + rng.randint(0, 40))]
            if rng.random() < 0.05:
                box[rng.randrange(4)] = rng.choice([None, math.nan])
            rows.append((image, f"b{k if rng.random() < 0.9 else 0:03d}", rng.choice([0.1, 0.5, rng.random(), rng.random(), None, math.nan] if rng.random() < 0.2 else [0.5, rng.random()]), *box, rng.choice("ab")))
    ones = {}
    for r in rows:
        ones.setdefault(r[:2], r)
    rows = [*ones.values(), (500, None, 0.9, 0.0, 0.0, 9.0, 9.0, "a"), (500, "z", 0.8, 50.0, 50.0, 60.0, 60.0, "b")]
    frame = spark.createDataFrame(rows, "image_id int, box_id string, score double, x0 double, y0 double, x1 double, y1 double, cls string").repartition(3)

    def overlap(a, b):
        if None in (*a, *b):
            return 0.0
        return math.nan if any(map(math.isnan, (*a, *b))) else iou(a, b)

    want = {}
    for image in {r[0] for r in rows}:
        left = {r[1]: [r[2], r[3:7]] for r in rows if r[0] == image and r[2] is not None and not r[2] <= 0.05}
        while left:
            top = min(left, key=lambda k: (math.isnan(left[k][0]), -left[k][0] if left[k][0] == left[k][0] else 0, k or ""))
            score, box = left.pop(top)
            want[image, top] = score
            for k in list(left):
                o = overlap(box, left[k][1])
                left[k][0] *= 1.0 if o <= 0.3 else 1 - o
                if left[k][0] <= 0.05:
                    del left[k]
    out = vision.softly_suppressed(frame, "image_id", least=0.05)
    got = {(r.image_id, r.box_id): (r.score, r.cls) for r in out.collect()}
    cls = {r[:2]: r[7] for r in rows}
    assert got.keys() == want.keys() and len(got) > 500
    assert all((math.isnan(want[k]) and math.isnan(s)) or math.isclose(s, want[k]) for k, (s, _) in got.items()) and all(c == cls[k] for k, (_, c) in got.items())
    assert out.columns == frame.columns and "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    assert vision.softly_suppressed(frame.limit(0), "image_id").isEmpty()


def brute_components(bits):
    h, w = bits.shape
    label, out = np.full((h, w), -1), []
    for x in range(w):
        for y in range(h):
            if bits[y, x] and label[y, x] < 0:
                todo, n = [(y, x)], 0
                label[y, x] = len(out)
                while todo:
                    a, b = todo.pop()
                    n += 1
                    for p in range(max(0, a - 1), min(h, a + 2)):
                        for q in range(max(0, b - 1), min(w, b + 2)):
                            if bits[p, q] and label[p, q] < 0:
                                label[p, q] = len(out)
                                todo.append((p, q))
                out.append((x * h + y, n))
    return label, out


def runs_of(bits):
    flat = bits.T.ravel().astype(int)
    cut = [0, *(np.flatnonzero(np.diff(flat)) + 1).tolist(), len(flat)]
    return ([0] if flat[0] else []) + np.diff(cut).tolist()


def test_components(spark):
    rng = np.random.default_rng(3)
    masks = {i: rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.0, 0.2, 0.5, 0.8, 1.0]) for i in range(60)}
    frame = spark.createDataFrame([(i, m.shape[0], runs_of(m)) for i, m in masks.items()], "id int, h int, counts array<long>")
    for on in (True, False):
        got = {}
        for r in vision.components(frame, on).collect():
            got.setdefault(r.id, []).append((r.component, r.area))
        for i, m in masks.items():
            assert sorted(got.get(i, [])) == sorted(brute_components(m if on else ~m)[1])
    for holes in (False, True):
        for r in vision.without_small(frame, 4, holes).collect():
            m = masks[r.id]
            label, parts = brute_components(~m if holes else m)
            small = [k for k, (_, n) in enumerate(parts) if n < 4]
            if not holes and parts and len(small) == len(parts):
                small.remove(max(range(len(parts)), key=lambda k: (parts[k][1], -k)))
            want = np.where(np.isin(label, small), holes, m)
            assert r.counts == runs_of(want) and r.changed == any(n < 4 for _, n in parts)
    assert vision.components(frame.limit(0)).count() == 0


def plain_alignment(a, b, gap, match, mismatch):
    score = [[gap * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            score[i][j] = max(score[i][j - 1] + gap, score[i - 1][j] + gap, score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch))
    out, i, j = [-1] * len(a), len(a), len(b)
    while i and j:
        if score[i][j] == score[i][j - 1] + gap:
            j -= 1
        elif score[i][j] == score[i - 1][j] + gap:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out[i] = j
    return out


def test_alignment():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        for gap, match, mismatch in ((0, 1, -1), (-1, 2, -1), (-2, 1, 0)):
            assert align.alignment(a, b, gap, match, mismatch) == plain_alignment(a, b, gap, match, mismatch)


def test_isolated_rows(spark):
    rows = spark.range(20).select(F.col("id").alias("k"))
    got = scorers.scored(rows, [scorers.isolated("inverse", lambda x: 10 / x["k"].where(x["k"] != 7).astype("Int64").map(lambda v: v if v else 1 / 0), ["k"])]).collect()
    assert len(got) == 20 and {r.k for r in got if r.inverse_error} == {0} and got[5].inverse == 2.0


def test_ssim_of_batches(spark, monkeypatch):
    """Pictures of several sizes in one batch against one window at a time; null where there is none."""
    rng = np.random.default_rng(3)
    size, w = 3, 4
    some = [(k, rng.integers(0, 256, h * w).tolist(), rng.integers(0, 256, h * w).tolist()) for k, h in enumerate([3, 5, 3, 8, 5, 3] * 5)]
    rows = [*some, (-1, None, [1] * 12), (-2, [1] * 12, [1] * 16), (-3, [1] * 8, [2] * 8), (-4, [], [])]
    at = np.arange(size) - 1
    k = np.exp(-(at**2) / (2 * 1.5**2))
    k = np.outer(k, k) / k.sum() ** 2

    def brute(a, b):
        a, b = (np.array(v, float).reshape(-1, w) for v in (a, b))
        out = []
        for y in range(len(a) - size + 1):
            for x in range(w - size + 1):
                p, q = (v[y : y + size, x : x + size] for v in (a, b))
                ma, mb = (k * p).sum(), (k * q).sum()
                va, vb, cov = (k * p * p).sum() - ma**2, (k * q * q).sum() - mb**2, (k * p * q).sum() - ma * mb
                out.append((2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma**2 + mb**2 + 6.5025) * (va + vb + 58.5225)))
        return np.mean(out)

    frame = spark.createDataFrame(rows, "k int, a array<int>, b array<int>").coalesce(1)
    for held in (1 << 18, 1, 30):
        monkeypatch.setattr(v, "SSIM_VALUES", held)
        got = {r.k: r.s for r in frame.select("k", v.ssim(F.col("a"), F.col("b"), w, size).alias("s")).collect()}
        assert all(got[i] is None for i in (-1, -2, -3, -4))
        assert all(abs(got[i] - brute(a, b)) < 1e-9 for i, a, b in some)


def test_rows_of_one_group_are_spread(spark, tmp_path):
    from curatrix.plans import base

    spark.range(200_000).selectExpr("id AS p_partkey", "uuid() AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    get = base.Tables(spark, str(tmp_path))
    assert get.spread("part").rdd.getNumPartitions() >= 4 and get.spread("part").count() == 200_000
