"""Filter interaction audit: what each order of five filters removes, where, and what of it was good or toxic.

A document's outcome depends only on which filters it fails: a mask of five bits. A table of 32 masks by 120 orders
holds the first step that fails. Tasks look masks up in it and count (part, order, step, label) with np.bincount; the
partial arrays are summed, and everything else follows from those sums.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import no_nulls, slices, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS, LABELS, MASKS = len(FILTERS) + 1, 4, 1 << len(FILTERS)  # the last step: no filter fails
REPEATED = 1 << FILTERS.index("E")
PIECE = 1 << 20
PARTS = 256  # whose arrays a task holds at once
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_MARKS = re.compile(rb"[#$%&*|]")


def first_failures() -> np.ndarray:
    """For each mask and order the first step, from 0, whose filter fails; 5 where none does."""
    letter = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    fails = (np.arange(MASKS)[:, None, None] >> letter) & 1
    return np.where(fails.any(2), fails.argmax(2), STEPS - 1)


def failures(text: bytes) -> int:
    """The mask of filters A to D for a text in UTF-8. Long texts are taken in pieces cut at white space, so that only
    the distinct words are held at once."""
    total, seen, at = 0, set(), 0
    while at < len(text):
        cut = _SPACES.search(text, min(at + PIECE, len(text)))
        end = cut.end() if cut else len(text)
        words = text[at:end].split()
        total += len(words)
        seen.update(words)
        at = end
    b = np.frombuffer(text, np.uint8)
    points = len(b) - int(np.count_nonzero((b & 0xC0) == 0x80))
    capitals = int(np.count_nonzero((b >= 65) & (b <= 90)))
    return (total < 200) | (100 * len(seen) < 50 * total) << 1 | (100 * capitals > 3 * points) << 2 | bool(_MARKS.search(text)) << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in slices(batches):
        col = x.column("text").cast(pa.binary())
        mask = np.fromiter((failures(t.as_py()) for t in col), np.int32, len(col))
        digest = pa.array([hashlib.sha256(t.as_py()).digest() for t in col], pa.binary())
        yield pa.RecordBatch.from_pydict({"doc_id": x.column("doc_id"), "part": x.column("part"), "mask": pa.array(mask), "h": digest})


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, mask, n): how many documents of a part and label fail which filters. label: 1 if quality is 1, and
    2 more if toxic is 1. Texts meet by hash as one row per part, label and text, so copies of one text, however many,
    are a few rows; a row without id fails E never and is no smaller one to others."""
    text = no_nulls(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_nulls(F.col("lang").cast("string")).alias("part"), text.alias("text"))
    rows = rows.mapInArrow(_masks, "doc_id long, part string, mask int, h binary")
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int") + 2 * (F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("label")
    )
    salt = F.when(rows["doc_id"].isNull(), F.xxhash64(rows["h"])).otherwise(0)  # rows without id find none, and spread
    rows = rows.join(marked, (rows["doc_id"] == marked["label_id"]) & (salt == F.coalesce(marked["label_id"], F.lit(0)) * 0), "left").withColumn("label", F.coalesce("label", F.lit(0)))
    same = ["h", "mask", "part", "label"]
    ids = rows.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    texts = ids.groupBy(*same).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("low"))
    texts = written(texts, "texts")
    least = texts.groupBy("h").agg(F.min("low.doc_id").alias("first"), F.count("*").alias("rows"), F.sum("known").alias("ids")).where("rows > 1 or ids > 1")
    texts = texts.join(written(least.select(F.col("h").alias("h2"), "first"), "first"), F.col("h") == F.col("h2"), "left")
    once = F.when(F.col("first").isNull(), F.col("known")).when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(F.lit(0))
    repeats = F.col("known") - F.coalesce(once, F.lit(0))
    both = texts.select("part", "label", F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - repeats).alias("n")), F.struct(F.col("mask").bitwiseOR(REPEATED).alias("mask"), repeats.alias("n")))).alias("x"))
    return both.select("part", "label", "x.mask", "x.n").where("n > 0")


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part an array of documents by order, step and label, behind it one by mask."""
    first = first_failures()
    cells = len(ORDERS) * STEPS * LABELS
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        lists = pa.array([a.tolist() for a in held.values()], pa.list_(pa.int64()))
        batch = pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.string()), "cells": lists})
        held.clear()
        return batch

    for x in slices(batches, 4096):
        mask, label, n = (x.column(c).to_numpy().astype(np.int64) for c in ("mask", "label", "n"))
        parts = x.column("part").dictionary_encode()
        which = parts.indices.to_numpy()
        code = (np.arange(len(ORDERS)) * STEPS + first[mask]) * LABELS + label[:, None]
        for k, part in enumerate(parts.dictionary.to_pylist()):
            at = which == k
            got = np.bincount(code[at].ravel(), np.repeat(n[at], len(ORDERS)), cells), np.bincount(mask[at], n[at], MASKS)
            if part not in held and len(held) == PARTS:
                yield out()
            held[part] = held.get(part, 0) + np.concatenate(got).astype(np.int64)
    if held:
        yield out()


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from rows of
    failure_counts: one per part, order and step, zeros included."""
    sums = counts.mapInArrow(_accumulate, "part string, cells array<long>").select("part", F.posexplode("cells")).groupBy("part", "pos").agg(F.sum("col").alias("n"))
    sums = written(sums, "cells")  # a fixed number of rows a part
    cells = len(ORDERS) * STEPS * LABELS
    named = F.array(*[F.lit(o) for o in ORDERS])
    label, step, order = F.col("pos") % LABELS, F.expr(f"cast(pos div {LABELS} as int) % {STEPS}"), F.expr(f"cast(pos div {LABELS * STEPS} as int)")
    steps = sums.where(F.col("pos") < cells).groupBy("part", F.element_at(named, order + 1).alias("filter_order"), (step + 1).cast("int").alias("step")).agg(
        F.sum("n").alias("removed"),
        F.sum(F.when(label % 2 == 1, F.col("n")).otherwise(0)).alias("good_lost"),
        F.sum(F.when(label >= 2, F.col("n")).otherwise(0)).alias("toxic_lost"),
    )
    line = Window.partitionBy("part", "filter_order")
    steps = steps.withColumn("kept", F.sum("removed").over(line) - F.sum("removed").over(line.orderBy("step"))).where(f"step < {STEPS}")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumn("letter", letter).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    mask = F.col("pos") - cells
    masks = sums.where(F.col("pos") >= cells).select("part", "n", mask.alias("mask"), F.explode(F.array(*[F.lit(c) for c in FILTERS])).alias("filter"))
    bit = F.expr(f"shiftright(mask, instr('{FILTERS}', filter) - 1) & 1")
    alone = F.expr(f"mask = shiftleft(1, instr('{FILTERS}', filter) - 1)")
    fails = masks.groupBy(F.col("part").alias("of"), "filter").agg(F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("unique_fails"))
    rows = steps.join(fails, (F.col("part") == F.col("of")) & (F.col("letter") == F.col("filter")))
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of `docs` (doc_id, text, lang) by part, its lang (null: empty). Null texts are empty ones and fail A.
    Rows of one doc_id and text are documents of their own, none smaller than the other. A doc_id with several labels
    counts as good or toxic as the highest says; ids without labels are neither. Other columns are ignored. No rows in,
    none out."""
    return audit(failure_counts(docs, labels))


def op13_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.k || b.k || x.k || y.k || z.k AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits FROM k a, k b, k x, k y, k z
    WHERE len(list_distinct([a.k, b.k, x.k, y.k, z.k])) = 5),
s AS (SELECT part, filter_order, step, bits[step] AS bit, n, good, toxic, mask, coalesce(list_position(list_transform(bits, lambda b: (mask & b) > 0), TRUE), 6) AS first
    FROM c, o, unnest([1, 2, 3, 4, 5]) u(step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (first > step) AS kept, sum(n) FILTER (first = step) AS removed, sum(n) FILTER (mask & bit > 0 AND first < step) AS redundant,
        sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (first = step) AS good_lost, sum(toxic) FILTER (first = step) AS toxic_lost
    FROM s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""
