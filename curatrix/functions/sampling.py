"""Draws that a seed and a key decide: the same on every run, whatever the partitioning, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, seed: str) -> Column:
    """A whole number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit("|"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def unit(key: Column, seed: str) -> Column:
    return draw(key, seed).cast("double") / F.lit(4294967296.0)


def pick(items: Column, key: Column, seed: str) -> Column:
    """One of the items, all equally likely; null if there are none."""
    return F.get(items, (draw(key, seed) % F.nullif(F.size(items), F.lit(0))).cast("int"))


def weighted(groups: list[tuple[float, list[str]]], key: Column, seed: str) -> Column:
    """A group by weight, then one of its items."""
    u, total, out = unit(key, seed + "-group"), 0.0, None
    for weight, items in groups:
        total += weight
        chosen = pick(F.array(*map(F.lit, items)), key, seed)
        out = F.when(u < total, chosen) if out is None else out.when(u < total, chosen)
    return out.otherwise(chosen)


def sample(items: Column, k: int, key: Column, seed: str) -> Column:
    """k of the items without replacement, in an order that the draw decides; items are strings."""
    order = lambda x: F.md5(F.concat(F.lit(seed), F.lit("|"), key.cast("string"), F.lit("|"), x))
    keyed = F.array_sort(F.transform(items, lambda x: F.struct(order(x).alias("h"), x.alias("v"))))
    return F.slice(F.transform(keyed, lambda s: s["v"]), 1, k)
