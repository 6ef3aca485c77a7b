"""Run-length set algebra and morphology against pixels, on grids of odd sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import runs
from curatrix.operators import vision

SIZES = [(1, 1), (1, 7), (7, 1), (3, 5), (8, 8), (11, 6), (17, 23)]


def grids():
    rng = np.random.default_rng(2)
    for h, w in SIZES:
        yield from (np.zeros((h, w), bool), np.ones((h, w), bool), *(rng.random((h, w)) < share for share in (0.1, 0.3, 0.5, 0.8, 0.95)))


def coded(grid):
    """Run lengths with an empty run thrown in here and there."""
    bits = grid.T.ravel()
    out, now = [0], False
    for b in bits:
        if b != now:
            out.append(0)
            now = b
        out[-1] += 1
    at = len(out) // 2
    return [*out[:at], out[at] // 2, 0, out[at] - out[at] // 2, *out[at + 1 :]]


def grid_of(counts, h, w):
    bits = np.repeat(np.arange(len(counts)) % 2, counts).astype(bool)
    assert len(bits) == h * w
    return bits.reshape(w, h).T


def proper(counts):
    return all(c > 0 for c in counts[1:])


def moved(grid, dy, dx, outside):
    out = np.full_like(grid, outside)
    h, w = grid.shape
    ys, xs = np.mgrid[0:h, 0:w]
    use = (ys + dy >= 0) & (ys + dy < h) & (xs + dx >= 0) & (xs + dx < w)
    out[use] = grid[(ys + dy)[use], (xs + dx)[use]]
    return out


@pytest.mark.parametrize("r", [0, 1, 2, 9])
@pytest.mark.parametrize("cross", [False, True])
def test_morphology(r, cross):
    near = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if not cross or not y or not x]
    for g in grids():
        h, w = g.shape
        s = runs.spans_of(np.array(coded(g)))
        wide, thin = (runs.counts_of(f(s, h, w, r, cross), h * w) for f in (runs.dilated, runs.eroded))
        assert proper(wide) and proper(thin)
        assert (grid_of(wide, h, w) == np.any([moved(g, y, x, False) for y, x in near], axis=0)).all()
        assert (grid_of(thin, h, w) == np.all([moved(g, y, x, True) for y, x in near], axis=0)).all()


def test_algebra(spark):
    some = list(grids())
    pairs = [(k, *a.shape, coded(a), coded(b)) for k, (a, b) in enumerate(zip(some, some[1:], strict=False)) if a.shape == b.shape]
    frame = spark.createDataFrame([*pairs, (-1, 1, 1, None, [1]), (-2, 0, 0, [], [])], "k int, h int, w int, a array<int>, b array<long>").repartition(3)
    a, b = F.col("a"), F.col("b")
    ops = {"u": (runs.union, np.logical_or), "i": (runs.intersection, np.logical_and), "d": (runs.difference, lambda x, y: x & ~y)}
    got = {r.k: r for r in frame.select("*", *[f(a, b).alias(c) for c, (f, _) in ops.items()], runs.normalised(a).alias("n"), runs.encoded(runs.decoded(a)).alias("e"), runs.mask_box(a, F.col("h")).alias("box")).collect()}
    assert got[-1].u is None and got[-1].n is None and got[-1].box is None and got[-2].u == [0]
    for k, h, w, x, y in pairs:
        gx, gy = grid_of(x, h, w), grid_of(y, h, w)
        for c, (_, op) in ops.items():
            assert proper(got[k][c]) and (grid_of(got[k][c], h, w) == op(gx, gy)).all()
        assert got[k].n == got[k].e and proper(got[k].n) and (grid_of(got[k].n, h, w) == gx).all()
        ys, xs = np.nonzero(gx)
        assert got[k].box == ([xs.min(), ys.min(), xs.max(), ys.max()] if len(xs) else [0, 0, 0, 0])


def test_crop_and_paste(spark):
    some = [(k, *g.shape, coded(g)) for k, g in enumerate(grids())]
    frame = spark.createDataFrame(some, "k int, h int, w int, a array<long>")
    at = lambda *n: [F.lit(x) for x in n]
    got = {r.k: r for r in frame.select("k", runs.paste(F.col("a"), F.col("h"), *at(9, 10, 4, -3)).alias("p"), runs.crop(F.col("a"), F.col("h"), *at(1, 0, 5, 3)).alias("c")).collect()}
    for k, h, w, a in some:
        g = grid_of(a, h, w)
        large = np.zeros((9, 10), bool)
        for y, x in zip(*np.nonzero(g), strict=True):
            if 0 <= y - 3 < 9 and x + 4 < 10:
                large[y - 3, x + 4] = True
        assert (grid_of(got[k].p, 9, 10) == large).all()
        part = np.zeros((3, 4), bool)
        inner = g[0:3, 1:5]
        part[: inner.shape[0], : inner.shape[1]] = inner
        assert (grid_of(got[k].c, 3, 4) == part).all()


def test_merged(spark, monkeypatch):
    rng = np.random.default_rng(8)
    some = [(None if k % 11 == 0 else f"g{k % 5}", g) for k, g in ((k, rng.random((6, 7)) < 0.1) for k in range(120))]
    frame = spark.createDataFrame([(n, coded(g)) for n, g in some], "name string, counts array<long>").repartition(6)
    for held in (1024, 1):
        monkeypatch.setattr(vision, "HELD", held)
        got = {r.name: r.counts for r in vision.merged_masks(frame, "name").collect()}
        for n in {x for x, _ in some}:
            assert (grid_of(got[n], 6, 7) == np.any([g for x, g in some if x == n], axis=0)).all()
        assert len(got) == 6
    assert vision.merged_masks(frame.limit(0), "name").count() == 0


def test_batches_of_masks(spark):
    """Masks of several sizes in one batch, with nulls, empty lists and images too large to lie end to end, against each alone."""
    some = [(k, *g.shape, coded(g), k % 3) for k, g in enumerate(grids())] * 4 + [(-1, 3, 3, None, 1), (-2, 2, 2, [], 1)] + [(-3, 1 << 57, 8, [5, 7, (1 << 60) - 12], 1)] * 9
    frame = spark.createDataFrame(some, "k int, h long, w int, a array<long>, r int").coalesce(1)
    a, h, w, r = map(F.col, "ahwr")
    got = frame.select("*", runs.dilation(a, h, w, r, True).alias("d"), runs.erosion(a, h, w, r).alias("e"), runs.difference(a, runs.erosion(a, h, w, r)).alias("x")).collect()
    assert len(got) == len(some)
    for g in got:
        if g.a is None:
            assert g.d is None and g.e is None and g.x is None
            continue
        s, size = runs.spans_of(np.array(g.a, np.int64)), g.h * g.w
        assert g.d == runs.counts_of(runs.dilated(s, g.h, g.w, g.r, True), size).tolist()
        thin = runs.eroded(s, g.h, g.w, g.r)
        assert g.e == runs.counts_of(thin, size).tolist()
        assert g.x == runs.counts_of(runs.combined(s, thin, lambda p, q: p & ~q), max(sum(g.a), size)).tolist()


def test_a_batch_is_worked_on_at_once(spark, monkeypatch):
    frame = spark.createDataFrame([([3, 2, 4],)] * 50, "a array<long>").coalesce(1)
    plain = runs.united
    calls = spark.sparkContext.accumulator(0)

    def counted(*spans):
        calls.add(1)
        return plain(*spans)

    monkeypatch.setattr(runs, "united", counted)
    assert frame.select(runs._batch(lambda step, m, a: counted(*a), lambda pixels: pixels[0], 1)(F.col("a")).alias("n")).distinct().collect()[0].n == [3, 2, 4]
    assert calls.value < 50


def flooded(bits):
    """Components of a grid as sets of pixels (column, row)."""
    left, out = set(zip(*np.nonzero(bits.T), strict=True)), []
    while left:
        todo, part = [min(left)], set()
        while todo:
            x, y = todo.pop()
            if (x, y) in left:
                left.remove((x, y))
                part.add((x, y))
                todo += [(x + i, y + k) for i in (-1, 0, 1) for k in (-1, 0, 1)]
        out.append(part)
    return out


def test_components_of_batches(spark):
    """Parts, islands and holes of masks of several sizes in one batch against a flood; heights and calls are few."""
    some = [(k, g.shape[0], coded(g)) for k, g in enumerate(grids())]
    frame = spark.createDataFrame([*some, (-1, 3, None), (-2, 3, [])], "id int, h int, counts array<long>").coalesce(1)
    by_id = {k: g for k, g in enumerate(grids())}
    for on in (True, False):
        want = {(k, min(x * g.shape[0] + y for x, y in p), len(p)) for k, g in by_id.items() for p in flooded(g == on)}
        assert {tuple(r) for r in vision.components(frame, on).collect()} == want
    for holes in (False, True):
        got = {r.id: r for r in vision.without_small(frame, 4, holes).collect()}
        assert got[-1].counts == [] == got[-2].counts and not got[-1].changed
        for k, h, counts in some:
            g, parts = by_id[k].copy(), flooded(by_id[k] != holes)
            small = [p for p in parts if len(p) < 4]
            if not holes and small and len(small) == len(parts):
                small.remove(max(small, key=lambda p: (len(p), tuple(-v for v in min(p)))))
            for p in small:
                for x, y in p:
                    g[y, x] = holes
            assert (grid_of(got[k].counts, *g.shape) == g).all()
            assert got[k].changed == any(len(p) < 4 for p in parts)
            assert got[k].changed or got[k].counts == counts


def test_labels_take_columns_of_all_masks(spark):
    col, top, end = (np.array(x) for x in ([0, 1, 5, 6], [0, 2, 0, 3], [2, 3, 1, 4]))
    assert vision._labels(col, top, end, 4).tolist() == [0, 0, 2, 3]
