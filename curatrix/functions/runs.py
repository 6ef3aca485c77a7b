"""Set algebra and morphology of masks that stay run lengths.

A mask is the lengths of its runs of pixels, column by column, the first run off and maybe empty. Operators work on the
places where runs begin and end, so their cost follows the runs and not the pixels, and give run lengths without empty
runs but for the first. Columns are Arrow functions over arrays of run lengths: a null mask gives null, an empty list is a
mask without pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<long>"
Spans = tuple[np.ndarray, np.ndarray]
ONE = 1 << 62  # the step of a mask that is alone


# --------------------------------------------------------------------------- spans: sorted, apart, from start to end


def spans_of(counts: np.ndarray) -> Spans:
    """Where the runs that are on begin and end."""
    ends = np.cumsum(counts)
    start, end = (ends - counts)[1::2], ends[1::2]
    return united(start, end)


def laid_out(values: np.ndarray, n: np.ndarray, step: int, on: bool = True) -> Spans:
    """Where the runs that are on, or off, begin and end, of masks whose run lengths follow each other in values, n of
    them each; mask k begins at k * step."""
    first, ends = np.cumsum(n) - n, np.cumsum(values)
    k = np.repeat(np.arange(len(n)), n)
    use = (np.arange(len(values)) - first[k]) % 2 == int(on)
    end = (ends - np.append(0, ends)[first][k] + k * step)[use]
    return united(end - values[use], end)


def united(start: np.ndarray, end: np.ndarray) -> Spans:
    """The union of spans in any order, which may overlap or touch."""
    use = end > start
    start, end = start[use], end[use]
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def counts_of(spans: Spans, size: int) -> np.ndarray:
    """Run lengths of spans in a mask of `size` pixels."""
    return lists_of(spans, np.array([size], np.int64), size + 1)[0]


def lists_of(spans: Spans, sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(run lengths, how many of them each mask has) of the spans of masks of so many pixels, of which mask k begins at
    k * step: at least a pixel lies between two masks."""
    start, end = spans
    of = start // step
    n = np.bincount(of, minlength=len(sizes))
    first = np.cumsum(2 * n + 2) - (2 * n + 2)
    marks = np.zeros(2 * len(start) + 2 * len(sizes), np.int64)
    at = np.arange(len(start)) * 2 + 1 + of * 2
    marks[at], marks[at + 1] = start - of * step, end - of * step
    last = first + 2 * n + 1
    marks[last] = sizes
    keep = np.ones(len(marks), bool)
    keep[first] = False
    out = np.diff(marks, prepend=0)
    keep[last[(n > 0) & (out[last] == 0)]] = False
    return out[keep], 2 * n + 1 - ((n > 0) & (out[last] == 0))


def combined(a: Spans, b: Spans, op: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Spans:
    """The spans where op of being in a and in b holds: one merge of the break points of both."""
    marks = np.unique(np.concatenate((*a, *b)))
    within = lambda s: np.searchsorted(s[0], marks[:-1], "right") > np.searchsorted(s[1], marks[:-1], "right")
    use = op(within(a), within(b))
    return united(marks[:-1][use], marks[1:][use])


def columns_of(spans: Spans, h: int, step: int = ONE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column, first row, row after the last, number of the mask) of spans cut at columns of h pixels; mask k begins at
    k * step."""
    start, end = spans
    of = start // step
    start, end = start - of * step, end - of * step
    first, last = start // h, (end - 1) // h
    n = last - first + 1
    col = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return col, np.maximum(np.repeat(start, n) - col * h, 0), np.minimum(np.repeat(end, n) - col * h, h), np.repeat(of, n)


def dilated(spans: Spans, h: int, w: int, r: int, cross: bool = False, step: int = ONE) -> Spans:
    """All pixels at most r rows and r columns from one of the spans; cross: of the same row or column."""
    col, top, end, of = columns_of(spans, h, step)
    at, tops, ends = [], [], []
    for d in range(-r, r + 1):
        tall = 0 if cross and d else r
        use = (col + d >= 0) & (col + d < w)
        at.append(of[use] * step + (col[use] + d) * h)
        tops.append(np.maximum(top[use] - tall, 0))
        ends.append(np.minimum(end[use] + tall, h))
    at = np.concatenate(at)
    return united(at + np.concatenate(tops), at + np.concatenate(ends))


def complement(spans: Spans, size: int, step: int = ONE, masks: int = 1) -> Spans:
    start, end = spans
    k = np.arange(masks)
    first, after = (np.searchsorted(start // step, k, side) for side in ("left", "right"))
    return united(np.insert(end, first, k * step), np.insert(start, after, k * step + size))


def eroded(spans: Spans, h: int, w: int, r: int, cross: bool = False, step: int = ONE, masks: int = 1) -> Spans:
    """The pixels whose neighbourhood, as far as it is in the image, is on."""
    return complement(dilated(complement(spans, h * w, step, masks), h, w, r, cross, step), h * w, step, masks)


def cropped(spans: Spans, h: int, x0: int, y0: int, x1: int, y1: int, step: int = ONE) -> Spans:
    """The spans within a box, of columns x0 to x1 and rows y0 to y1 without their ends, as a mask of the box's size."""
    col, top, end, of = columns_of(spans, h, step)
    use = (col >= x0) & (col < x1)
    at = of[use] * step + (col[use] - x0) * (y1 - y0)
    top, end = np.clip(top[use] - y0, 0, y1 - y0), np.clip(end[use] - y0, 0, y1 - y0)
    return united(at + top, at + end)


def pasted(spans: Spans, h: int, to_h: int, to_w: int, x: int, y: int, step: int = ONE) -> Spans:
    """The spans of a mask of height h in one of to_h by to_w, moved by x columns and y rows; what leaves it is lost."""
    col, top, end, of = columns_of(spans, h, step)
    col = col + x
    use = (col >= 0) & (col < to_w)
    at = of[use] * step + col[use] * to_h
    return united(at + np.clip(top[use] + y, 0, to_h), at + np.clip(end[use] + y, 0, to_h))


# --------------------------------------------------------------------------- columns


def _each(col: pa.Array) -> Iterator[np.ndarray | None]:
    """The lists of a column, as arrays over its own memory."""
    ends, values, valid = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype(np.int64), col.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(col)):
        yield values[ends[i] : ends[i + 1]] if valid[i] else None


def _lists(found: list[np.ndarray | None]) -> pa.Array:
    size = np.cumsum([0, *(0 if x is None else len(x) for x in found)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *(x for x in found if x is not None)])
    none = pa.array([x is None for x in found], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(size), pa.array(values), mask=none if len(found) else None)


def _column(work: Callable[..., np.ndarray], masks: int):
    """An Arrow function of so many masks and any further whole numbers."""

    def run(*cols: pa.Array) -> pa.Array:
        rows = zip(*(_each(c) for c in cols[:masks]), *(c.to_pylist() for c in cols[masks:]), strict=True)
        return _lists([None if any(x is None for x in r) else work(*r) for r in rows])

    return F.arrow_udf(run, RUNS)


def _batch(work: Callable[..., Spans], size: Callable[..., np.ndarray | int], masks: int):
    """An Arrow function of so many masks and any further whole numbers. Masks of equal numbers are worked on at once,
    laid end to end with room between: work(step, how many, spans of each column, *numbers) gives their spans, and
    size(pixels of each column, *numbers) their pixels."""

    def some(lists: list[tuple[np.ndarray, np.ndarray]], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ends = [np.cumsum(v) for v, _ in lists]
        before = [np.append(0, e)[np.cumsum(n) - n] for e, (_, n) in zip(ends, lists, strict=True)]
        pixels = [np.append(0, e)[np.cumsum(n)] - b for e, b, (_, n) in zip(ends, before, lists, strict=True)]
        m = len(lists[0][1])
        sizes = np.broadcast_to(np.asarray(size(pixels, *numbers), np.int64), m)
        step = max(int(sizes.max()), *(int(p.max()) for p in pixels), 0) + 1
        if m > 1 and step > ONE // m:
            cut = m // 2
            halves = ([(v[: n[:cut].sum()], n[:cut]) for v, n in lists], [(v[n[:cut].sum() :], n[cut:]) for v, n in lists])
            return tuple(map(np.concatenate, zip(*(some(x, numbers) for x in halves), strict=True)))
        spans = [laid_out(v, n, step) for v, n in lists]
        return lists_of(work(step, m, *spans, *numbers), sizes, step)

    def run(*cols: pa.Array) -> pa.Array:
        valid = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in cols])
        at = np.flatnonzero(valid)
        cols = [c.take(pa.array(at)) for c in cols]
        numbers = np.column_stack([np.zeros(len(at), np.int64), *(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols[masks:])])
        kinds, kind = np.unique(numbers, axis=0, return_inverse=True)
        values, sizes, rows = [np.zeros(0, np.int64)], np.zeros(len(valid), np.int64), [np.zeros(0, np.int64)]
        for i, k in enumerate(kinds):
            use = np.flatnonzero(kind.ravel() == i)
            lists = [c.take(pa.array(use)) for c in cols[:masks]]
            lists = [(c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) for c in lists]
            v, n = some(lists, k[1:].tolist())
            values.append(v)
            sizes[at[use]] = n
            rows.append(np.repeat(at[use], n))
        order = np.argsort(np.concatenate(rows), kind="stable")
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)[order]), mask=pa.array(~valid) if len(valid) else None)

    return F.arrow_udf(run, RUNS)


def _set(op: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """op is false where both are."""
    return _batch(lambda step, m, a, b: combined(a, b, op), lambda pixels: np.maximum(*pixels), 2)


def union(a: Column, b: Column) -> Column:
    return _set(lambda x, y: x | y)(a, b)


def intersection(a: Column, b: Column) -> Column:
    return _set(lambda x, y: x & y)(a, b)


def difference(a: Column, b: Column) -> Column:
    """What of a is not in b."""
    return _set(lambda x, y: x & ~y)(a, b)


def normalised(counts: Column) -> Column:
    """The same mask without empty runs but for the first."""
    return _batch(lambda step, m, a: a, lambda pixels: pixels[0], 1)(counts)


def encoded(bits: Column) -> Column:
    """The runs of an array of 0 and 1: in one pass over it."""

    def work(b: np.ndarray) -> np.ndarray:
        edge = np.diff(np.concatenate(([0], b != 0, [0])).astype(np.int8))
        return counts_of((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), len(b))

    return _column(work, 1)(bits)


def decoded(counts: Column) -> Column:
    """The pixels of a mask, an array of 0 and 1."""
    return _column(lambda a: np.repeat(np.arange(len(a)) % 2, a), 1)(counts)


def dilation(counts: Column, h: Column, w: Column, r: Column, cross: bool = False) -> Column:
    """The mask and what is at most r rows and columns from it; with cross in the same row or column only."""
    return _batch(lambda step, m, a, h, w, r: dilated(a, h, w, r, cross, step), lambda pixels, h, w, r: h * w, 1)(counts, h, w, r)


def erosion(counts: Column, h: Column, w: Column, r: Column, cross: bool = False) -> Column:
    """What of the mask is more than r rows or columns from all that is off; the border erodes nothing."""
    return _batch(lambda step, m, a, h, w, r: eroded(a, h, w, r, cross, step, m), lambda pixels, h, w, r: h * w, 1)(counts, h, w, r)


def crop(counts: Column, h: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a mask of height h in a box (columns x0 to x1, rows y0 to y1 without their ends), of the box's size."""
    return _batch(lambda step, m, a, h, x0, y0, x1, y1: cropped(a, h, x0, y0, x1, y1, step), lambda pixels, h, x0, y0, x1, y1: (x1 - x0) * (y1 - y0), 1)(counts, h, x0, y0, x1, y1)


def paste(counts: Column, h: Column, to_h: Column, to_w: Column, x: Column, y: Column) -> Column:
    """A mask of height h as one of to_h by to_w, with its corner at column x and row y."""
    return _batch(lambda step, m, a, h, to_h, to_w, x, y: pasted(a, h, to_h, to_w, x, y, step), lambda pixels, h, to_h, to_w, x, y: to_h * to_w, 1)(counts, h, to_h, to_w, x, y)


def mask_box(counts: Column, h: Column) -> Column:
    """(x0, y0, x1, y1) of the outermost pixels of a mask of height h as an array; zeros for an empty one."""

    def work(a: np.ndarray, h: int) -> np.ndarray:
        col, top, end, _ = columns_of(spans_of(a), h)
        return np.array([col.min(), top.min(), col.max(), end.max() - 1]) if len(col) else np.zeros(4, np.int64)

    return _column(work, 1)(counts, h)
