"""Exact dedup by progressive refinement, in DataFrame operations alone.

Texts are equal when equal without white space. Rows are grouped by length, what repeats by length and prefix hash,
and only rows that still have company get the hash of their full text. What survives a level reaches the next scan as a
filter of a fixed number of bits, so no text is shuffled and the broadcast has a bound whatever the corpus: a bit set by
chance costs one more hash and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import grouped_join, no_nulls, written

SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 128
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27  # of a filter: 4 KB to 16 MB


def normalised(text: Column) -> Column:
    """The text without white space; a null one is empty."""
    return F.regexp_replace(no_nulls(text), SPACE, "")


def _place(bits: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits)) + 1


def repeated_filter(rows: DataFrame, bits: int, *key: str) -> DataFrame:
    """(bucket, bits): a bit for each key that several rows hold. At most bits / 32768 rows of 4 KB."""
    again = rows.groupBy(*key).count().where("count > 1").select(_place(bits, *key).alias("place"))
    return again.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def may_repeat(rows: DataFrame, filters: DataFrame, bits: int, *key: str) -> DataFrame:
    """`rows` with a boolean `again`: whether the bit of their key is set. The filter is broadcast; its size is bounded by `bits`."""
    place = _place(bits, *key)
    rows = rows.withColumn("place_bucket", F.bitmap_bucket_number(place)).withColumn("place_bit", F.bitmap_bit_position(place))
    rows = rows.join(F.broadcast(filters), F.col("place_bucket") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(place_bit div 8 as int) + 1"), F.lit(1))), 16, 10).cast("long")
    again = F.coalesce(F.getbit(byte, F.expr("cast(place_bit % 8 as int)")) == 1, F.lit(False))
    return rows.withColumn("again", again).drop("place_bucket", "place_bit", "bucket", "bits")


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`. Of rows with equal text one is kept:
    that with the most code points in the original text, then the smallest doc_id, null last. text_sha256 is the hash
    of the normalised text where the full text was read, or of all rows with `digest`. Null texts are empty, and equal
    to other texts without anything but white space. Of repeated rows with one doc_id one alone is kept. Other columns
    are ignored, whatever their names. No rows in, none out."""
    text = no_nulls(F.col(text_col))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), normalised(F.col(text_col)).alias("n"))
    narrow = read.select("n", "t", "doc_id", F.octet_length("n").alias("size"), F.xxhash64(F.substring("n", 1, PREFIX)).alias("head"))
    keys = written(narrow.select("size", "head"), "keys")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys.count()).bit_length()))
    sizes = written(repeated_filter(keys, bits, "size"), "sizes")
    heads = written(repeated_filter(may_repeat(keys, sizes, bits, "size").where("again"), bits, "size", "head"), "heads")
    left = may_repeat(narrow, heads, bits, "size", "head")
    full = F.sha2(F.col("n").cast("binary"), 256)
    rows = left.select("doc_id", F.length("t").alias("points"), F.when(F.col("again"), full).alias("full"), (full if digest else F.when(F.col("again"), full)).alias("text_sha256"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = rows.where("full is not null").groupBy("full").agg(F.count("*").alias("n"), best.alias("best"))
    groups = written(groups.select("full", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    found = grouped_join(rows, groups, "full")
    alone = F.col("full").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n")).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that exact_duplicates keeps, with all their columns. Rows without id stay or go by their text
    alone."""
    named = docs.select(F.struct("*").alias("whole"), F.col(id_col).cast("long").alias("i"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("h"))
    decided = exact_duplicates(docs, text_col, id_col).where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    decided = written(decided.where("not stays or rows > 1"), "decided")
    same = named["i"].eqNullSafe(decided["doc_id"]) & (named["h"] == decided["text_sha256"])
    kept = named.join(decided, same, "left_anti").select("whole")
    twice = named.join(decided.where("stays"), same, "left_semi").withColumn("points", F.length(no_nulls(F.col(f"whole.{text_col}"))))
    one = twice.groupBy("i", "h").agg(F.max_by("whole", "points").alias("whole")).select("whole")
    return kept.union(one).select("whole.*")


def op12_exact(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY t) AS group_size FROM d
    WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM r"""
