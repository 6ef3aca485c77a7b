"""Column expressions over number arrays: similarities, distances and the like, in higher-order functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


SSIM_VALUES = 1 << 18


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a at length one; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def direction_similarity(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Cosine of the change from a to b with that from ta to tb; 0 if either stands still."""
    return dot(unit(difference(b, a)), unit(difference(tb, ta)))


def pixel_distance(a: Column, b: Column, wrapping: bool = False) -> Column:
    """Mean absolute difference of values 0 to 255, as a share of 255. wrapping: the difference of unsigned bytes,
    which is not symmetric."""
    step = (lambda x, y: F.pmod(x - y, F.lit(256))) if wrapping else (lambda x, y: F.abs(x - y))
    return total(F.zip_with(a, b, lambda x, y: step(x, y).cast("double"))) / F.size(a) / 255


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(x: Column, eps: float = 1e-3) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.ln(F.greatest(x, F.lit(eps)) / F.greatest(1 - x, F.lit(eps)))


def psnr(mse: Column) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(255.0 / F.sqrt(mse)))


def structure(var_a: Column, var_b: Column, cov: Column, c: float = 0.03**2 * 255**2 / 2) -> Column:
    return (cov + c) / (F.sqrt(var_a) * F.sqrt(var_b) + c)


def f_score(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    return (1 + beta**2) * precision * recall / F.nullif(beta**2 * precision + recall, F.lit(0.0))


def affine(a: Column, weights: Column, bias: float) -> Column:
    """What a stack of linear layers without activations comes to."""
    return dot(a, weights) + bias


def rotation(q: Column) -> Column:
    """Row-major 3 x 3 matrix of a quaternion (w, x, y, z)."""
    w, x, y, z = (q[i] for i in range(4))
    return F.array(
        1 - 2 * y * y - 2 * z * z, 2 * x * y - 2 * w * z, 2 * z * x + 2 * w * y,
        2 * x * y + 2 * w * z, 1 - 2 * x * x - 2 * z * z, 2 * y * z - 2 * w * x,
        2 * z * x - 2 * w * y, 2 * y * z + 2 * w * x, 1 - 2 * x * x - 2 * y * y,
    )


def quaternion_product(a: Column, b: Column) -> Column:
    aw, ax, ay, az = (a[i] for i in range(4))
    bw, bx, by, bz = (b[i] for i in range(4))
    return F.array(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def relative_rotation(a: Column, b: Column) -> Column:
    """The quaternion that turns a into b."""
    return quaternion_product(b, F.array(a[0], -a[1], -a[2], -a[3]))


def quaternion(m: Column) -> Column:
    """The quaternion (w, x, y, z), w not negative, of a row-major 3 x 3 rotation matrix: of the four ways to divide, the
    one by the greatest number."""
    r = lambda i, j: m[3 * i + j]
    squares = [1 + r(0, 0) + r(1, 1) + r(2, 2), 1 + r(0, 0) - r(1, 1) - r(2, 2), 1 - r(0, 0) + r(1, 1) - r(2, 2), 1 - r(0, 0) - r(1, 1) + r(2, 2)]
    by = [
        [squares[0], r(2, 1) - r(1, 2), r(0, 2) - r(2, 0), r(1, 0) - r(0, 1)],
        [r(2, 1) - r(1, 2), squares[1], r(0, 1) + r(1, 0), r(0, 2) + r(2, 0)],
        [r(0, 2) - r(2, 0), r(0, 1) + r(1, 0), squares[2], r(1, 2) + r(2, 1)],
        [r(1, 0) - r(0, 1), r(0, 2) + r(2, 0), r(1, 2) + r(2, 1), squares[3]],
    ]
    most, out = F.greatest(*squares), None
    for s, row in zip(squares, by, strict=True):
        q = F.array(*[x / (2 * F.sqrt(s)) for x in row])
        out = F.when(s == most, q) if out is None else out.when(s == most, q)
    return F.transform(out, lambda x: x * F.when(out[0] < 0, -1.0).otherwise(1.0))


def ssim(a: Column, b: Column, w: int, size: int = 11, sigma: float = 1.5) -> Column:
    """Structural similarity of two grey images of rows of w values 0 to 255, averaged over the places where a Gaussian
    window fits; null where none does or the images differ in size. A window is a matrix, so it runs on Arrow batches."""
    at = np.arange(size) - (size - 1) / 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2

    def means(x: np.ndarray) -> np.ndarray:
        x = sum(k * x[:, i : x.shape[1] - size + 1 + i] for i, k in enumerate(kernel))
        return sum(k * x[:, :, i : x.shape[2] - size + 1 + i] for i, k in enumerate(kernel))

    def some(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        mx, my = means(x), means(y)
        vx, vy, cov = means(x * x) - mx * mx, means(y * y) - my * my, means(x * y) - mx * my
        return (((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean((1, 2))

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        pairs = [(-1 if p is None or q is None or len(p) != len(q) else len(p)) for p, q in zip(x, y, strict=True)]
        for n in {n for n in pairs if n // w >= size <= w}:  # images of one size at once, of about SSIM_VALUES values
            rows = np.flatnonzero(np.array(pairs) == n)
            many = max(1, SSIM_VALUES // n)
            for at in (rows[i : i + many] for i in range(0, len(rows), many)):
                out[at] = some(*(np.stack([v.iloc[i] for i in at]).astype(np.float64).reshape(len(at), -1, w) for v in (x, y)))
        return pd.Series(out)  # not a number is null

    return run(a, b)


def stability(logits: Column, threshold: Column, offset: Column) -> Column:
    """Pixels over threshold + offset as a share of those over threshold - offset; null if there are none of these."""
    over = lambda t: F.size(F.filter(logits, lambda x: x > t))
    return F.try_divide(over(threshold + offset), over(threshold - offset))
