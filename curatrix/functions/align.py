"""Alignment of word sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def alignment(a: list[str], b: list[str], gap: int = 0, match: int = 1, mismatch: int = -1) -> list[int]:
    """For each word of a the position of its partner in b in a best global alignment, -1 for none. Of equally good
    steps back, a gap in a comes first, then a gap in b, then a pair."""
    words = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([words[w] for w in s], np.int64) for s in (a, b))
    slope = gap * np.arange(len(b) + 1)
    score = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    score[0] = slope
    for i in range(1, len(a) + 1):  # a row at once: steps along it are a running maximum
        best = np.append(gap * i, np.maximum(score[i - 1, 1:] + gap, score[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch)))
        score[i] = np.maximum.accumulate(best - slope) + slope
    score = score.tolist()
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


def aligned(a: Column, b: Column) -> Column:
    """alignment() of the words of two texts: a table over both, so it runs on Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else alignment(p.split(), q.split()) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def word_differences(a: Column, b: Column) -> Column:
    """Positions at which two texts of equally many words differ; null if they aren't equally long."""
    x, y = F.split(a, " "), F.split(b, " ")
    at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) != F.get(y, i))
    return F.when(F.size(x) == F.size(y), at)
