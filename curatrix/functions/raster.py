"""Pictures as arrays of numbers, row by row: grey values and resampling to another size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The shares of red, green and blue in a grey value.
GREY = (0.299, 0.587, 0.114)
# End of fixed values.


def grey(rgb: Column) -> Column:
    """An array of red, green and blue in turn as one of grey values."""
    part = lambda k: F.filter(rgb, lambda _, i: i % 3 == k)
    both = F.zip_with(part(0), part(1), lambda r, g: r * GREY[0] + g * GREY[1])
    return F.zip_with(both, part(2), lambda s, b: s + b * GREY[2])


def weights(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of `to` places along an axis of n: the two places that it lies between, centre to centre and within the
    edges, and the share of the second."""
    at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
    low = np.minimum(at.astype(np.int64), max(0, n - 2))
    return low, np.minimum(low + 1, n - 1), at - low


def resampled(x: np.ndarray, to_h: int, to_w: int) -> np.ndarray:
    """A picture in another size, linear between its places: along one axis, then along the other."""
    for axis, to in ((0, to_h), (1, to_w)):
        low, high, share = weights(x.shape[axis], to)
        share = share[:, None] if axis == 0 else share
        x = x.take(low, axis) * (1 - share) + x.take(high, axis) * share
    return x


def resized(values: Column, h: Column, w: Column, to_h: Column, to_w: Column) -> Column:
    """An array of h by w values, row by row, as one of to_h by to_w; null if anything is, or it has another number."""

    def run(values: pa.Array, *sides: pa.Array) -> pa.Array:
        out = []
        for x, h, w, to_h, to_w in zip(values.to_pylist(), *(s.to_pylist() for s in sides), strict=True):
            whole = None not in (x, h, w, to_h, to_w) and len(x) == h * w > 0 and to_h > 0 and to_w > 0
            out.append(resampled(np.array(x, np.float64).reshape(h, w), to_h, to_w).ravel() if whole else None)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(values, h, w, to_h, to_w)
