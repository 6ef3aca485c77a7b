"""Records that span lines, read from any split of a file: objects of JSON arrays, and records of two lines.

Spark's text source cuts large files into splits at a separator. What a piece of text means depends on what came before
it, so a first pass sums up each split (by how much it changes the depth of brackets, whether it changes from within a
string to without, how many lines it has), a fold over the few splits of a file gives each the state that it starts in,
and a second pass goes through all splits at once. A record that a split's end cuts in two is put together again by a
grouping of such fragments, one or two for each end of a split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.sources.record_files import file_system

ROWS = 4096
HEAD = 1 << 16
FOUND = "file string, of long, block long, whole boolean, text string"


def pieces(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """(file, block, value): the text between separators, in the order of each split, a file and the place where it
    starts."""
    return spark.read.option("lineSep", sep).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch], *state: str) -> Iterator[tuple[tuple, list[str], bool]]:
    """(key, values, last): the values of one split at a time, in slices; key: file, block and the columns of its state."""
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            x = batch.slice(at, ROWS)
            keys = list(zip(*(x.column(c).to_pylist() for c in ("file", "block", *state)), strict=True))
            values, i = x.column("value").to_pylist(), 0
            while i < len(keys):
                to = i + 1
                while to < len(keys) and keys[to] == keys[i]:
                    to += 1
                if held:
                    yield *held, held[0] != keys[i]
                held = keys[i], values[i:to]
                i = to
    if held:
        yield *held, True


def _starts(spark_rows: DataFrame, summed: DataFrame, on: list[str]) -> DataFrame:
    """spark_rows with the state of their split: one row a split, broadcast, so that rows keep their order."""
    state = summed.withColumnsRenamed({c: f"of_{c}" for c in on})
    return spark_rows.join(F.broadcast(state), [spark_rows[c] == state[f"of_{c}"] for c in on]).drop(*[f"of_{c}" for c in on])


def _joined(found: DataFrame) -> DataFrame:
    """(text) of whole records, and of those that fragments make."""
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    cut = found.where("not whole").groupBy("file", "of").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return found.where("whole").select("text").union(cut.select("text"))


# --------------------------------------------------------------------------- JSON arrays

_QUOTE, _BACK, _OPEN, _CLOSE = (ord(c) for c in '"\\{}')


def _marks(values: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of pieces that end before a closing brace: their bytes, with it; at each byte how many quotes that no backslash
    escapes came so far; and the step in depth that it would be outside of strings."""
    text = ("}".join(values) + "}").encode()
    b = np.frombuffer(text, np.uint8)
    at = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != _BACK, at, -1))  # the last byte that is no backslash
    before = np.concatenate(([-1], plain[:-1]))
    quote = (b == _QUOTE) & ((at - 1 - before) % 2 == 0)
    step = np.zeros(len(b), np.int64)
    step[(b == _OPEN) | (b == ord("["))] = 1
    step[(b == _CLOSE) | (b == ord("]"))] = -1
    return text, np.cumsum(quote), step


SUMMARY = "file string, block long, flips boolean, delta array<long>, least array<long>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: whether it turns string into no string, and for a start without and within a string the change of
    depth and the least depth on the way."""
    quotes, delta, least = 0, [0, 0], [0, 0]
    for (file, block), values, last in _runs(batches):
        _, count, step = _marks(values)
        for k in (0, 1):
            depth = delta[k] + np.cumsum(np.where((count + quotes + k) % 2 == 0, step, 0))
            least[k] = min(least[k], int(depth.min(initial=0)))
            delta[k] = int(depth[-1])
        quotes += int(count[-1])
        if last:
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "flips": [quotes % 2 == 1], "delta": [delta], "least": [least]})
            quotes, delta, least = 0, [0, 0], [0, 0]


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """The state that each split of a file starts in: within a string or not, its depth, and the split in which the record
    that is open there began."""
    inside, depth, since, out = False, 0, 0, []
    for r in rows.sort_values("block").itertuples():
        out.append((r.file, r.block, inside, depth, since))
        k = int(inside)
        if depth + r.least[k] <= 1:  # between records at some point
            since = r.block
        depth += r.delta[k]
        inside ^= bool(r.flips)
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth", "since"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND: the objects of each split, those that begin or end in another one as fragments."""
    now, pending = None, []
    for (file, block, inside, start, since), values, last in _runs(batches, "inside", "depth", "since"):
        if now is None:
            now = [int(inside), start, start > 1, since if start > 1 else block]  # quotes, depth, whether a record of another split is open, and of which
        text, count, step = _marks(values)
        depth = now[1] + np.cumsum(np.where((count + now[0]) % 2 == 0, step, 0))
        moved = np.diff(depth, prepend=now[1])
        b = np.frombuffer(text, np.uint8)
        opens, closes = np.flatnonzero((moved == 1) & (depth == 2) & (b == _OPEN)), np.flatnonzero((moved == -1) & (depth == 1) & (b == _CLOSE))
        out: list[tuple] = []
        at = 0
        if pending or now[2]:
            end = int(closes[0]) + 1 if len(closes) else len(text)
            pending.append(text[:end])
            at = end
            if len(closes):
                out.append((file, now[3], block, not now[2], b"".join(pending).decode()))
                pending, now[2], now[3] = [], False, block
        k = int(np.searchsorted(closes, at))
        for o in opens[np.searchsorted(opens, at) :].tolist():
            k = k + int(np.searchsorted(closes[k:], o))
            if k == len(closes):
                pending = [text[o:]]
                break
            out.append((file, block, block, True, text[o : int(closes[k]) + 1].decode()))
        now[0], now[1] = now[0] + int(count[-1]), int(depth[-1])
        if last:
            if pending:
                out.append((file, now[3] if now[2] else block, block, False, b"".join(pending).decode()))
            now, pending = None, []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["file", "of", "block", "whole", "text"])


def array_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(text): the objects of the JSON arrays in files, each as it is written. Elements that are no objects are left
    out. A file may be one line and of any size; no task holds more than a split of it, and an object."""
    rows = pieces(spark, paths, "}")
    summed = rows.mapInArrow(_summed, SUMMARY).groupBy("file").applyInPandas(_folded, "file string, block long, inside boolean, depth long, since long")
    return _joined(_starts(rows, summed, ["file", "block"]).mapInArrow(_objects, FOUND))


def first_characters(spark: SparkSession, path: str) -> DataFrame:
    """(file, first): of each file at `path`, a file or folder, the first character that is no white space, null if its
    first HEAD bytes have none."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            names, first = x.column("file").to_pylist(), []
            for name in names:
                fs, at = file_system(name)
                with fs.open_input_file(at) as file:
                    head = file.read_at(HEAD, 0).decode("utf-8-sig", "ignore").lstrip()
                    first.append(head[:1] or None)
            yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "first": pa.array(first, pa.string())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))  # contents are not read
    return files.mapInArrow(look, "file string, first string")


def read_json(spark: SparkSession, path: str, schema: str, array: bool | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Records of the files at `path`: JSON arrays of objects, or a JSON object a line, by the first character of each
    file unless `array` says. Arrays are read in splits as lines are. mode DROPMALFORMED leaves out what isn't JSON;
    PERMISSIVE makes it a row of nulls, of an array each object for itself."""
    if array is None:
        files = first_characters(spark, path).groupBy((F.col("first") == "[").alias("array")).agg(F.collect_list("file").alias("files"))
        found = {bool(r.array): r.files for r in files.collect()}  # paths, as the scan lists them too
    else:
        found = {array: path}
    out = None
    for kind, files in found.items():
        if kind:
            rows = array_objects(spark, files).select(F.from_json("text", f"struct<{schema}>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "text")
            rows = (rows.where(F.expr("json_object_keys(text) is not null")) if mode == "DROPMALFORMED" else rows).select("r.*")
        else:
            rows = spark.read.schema(schema).option("mode", mode).json(files)
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


# --------------------------------------------------------------------------- lines and records of two lines


def _with_lines_before(rows: DataFrame) -> DataFrame:
    """pieces() that are lines with `before`: how many the splits of their file before theirs have."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over the splits of a file
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    return _starts(rows, counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), ["file", "block"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for (file, _, before), values, last in _runs(batches, "before"):
        now = before if now is None else now
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(values), pa.string()), pa.array(range(now, now + len(values)), pa.int64()), pa.array(values, pa.string())], ["file", "pos", "line"])
        now = None if last else now + len(values)


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pos, line): the lines of files, without their ends, by their number from 0 on."""
    rows = pieces(spark, paths, "\n").withColumn("value", F.rtrim("value", F.lit("\r")))
    return _with_lines_before(rows).mapInArrow(_positions, "file string, pos long, line string")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND: two lines, and a line feed between them, of each pair; of one that a split's end cuts each line for itself."""
    now, head = None, None
    for (file, block, before), values, last in _runs(batches, "before"):
        if now is None:
            now, head = before, None
        out: list[tuple] = []
        for line in values:
            if now % 2 == 0:
                head = line
            else:
                out.append((file, now // 2, block, head is not None, f"{head or ''}\n{line}"))
                head = None
            now += 1
        if last:
            if head is not None:
                out.append((file, now // 2, block, False, head))
            now = head = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["file", "of", "block", "whole", "text"])


def line_pairs(spark: SparkSession, paths: str | list[str], comment: Column) -> DataFrame:
    """(text): two lines of a file at a time, with a line feed between them, after those that `comment` holds for (over
    value) are left out. A last line alone is a text without line feed."""
    rows = pieces(spark, paths, "\n").withColumn("value", F.rtrim("value", F.lit("\r"))).where(~comment)
    return _joined(_with_lines_before(rows).mapInArrow(_pairs, FOUND))
