"""Mixing sources to target weights, in DataFrame operations alone.

Words are added up per source, a water level is found over the sources, and each document gets the rate of its
source: floor(rate) copies, and one more where a hash of its id falls under the fraction. The level: source i may
take min(cap * size_i, weight_i * level). Sources sorted by cap * size / weight reach their cap in that order, so
running sums give the level without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A number from 0 to 1 that only key and seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size). Sources by code point, null last, weigh
    1, 2, 3, repeating. The windows run over one row per source, whatever the number of documents."""
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", ((F.row_number().over(named) - 1) % 3 + 1).cast("long"))
    reach = (F.col("source_size") * cap) / F.col("weight")
    order = Window.orderBy(F.col("reach"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranked.withColumn("reach", reach)
    rows = rows.select(
        "source", "source_size", "weight", "reach",
        F.sum("source_size").over(whole).alias("total"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
        (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap).alias("closed"),
    )
    level = (F.col("total") - F.col("closed")) / F.col("open_weight")
    # the first source, in order of reach, that the level does not fill sets the level for all after it
    rows = rows.withColumn("level", F.when(F.col("reach") > level, level))
    rows = rows.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("reach"))).over(whole))
    target = F.least((F.col("source_size") * cap).cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(float("inf"))))
    return rows.select("source", "source_size", target.alias("target"))


def mix_rates(docs: DataFrame, cap: int = CAP, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """`docs` with mix_size (its words), mix_source_size, mix_target (its source's) and mix_copies (how often the
    mix takes the document). Null source: a source of its own, last in order. Null text: no words. A source
    without words has target 0 and its documents 0 copies. Rows with equal id and source get equal copies. No
    rows in, none out. Columns of these four names are replaced; other columns stay as they are."""
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    sized = docs.withColumn("mix_size", word_count(F.col("text")))
    sums = sized.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    goal = source_targets(sums, cap).select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rows = sized.join(goal, sized["source"].eqNullSafe(goal["mix_source"])).drop(goal["mix_source"])
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    copies = F.floor(rate) + (unit_hash(F.col(id_col), seed) < rate - F.floor(rate)).cast("long")
    return rows.withColumn("mix_copies", copies.cast("long"))


def mix(docs: DataFrame, cap: int = CAP, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """The mix: each row of `docs` as often as mix_copies says (see mix_rates), with copy_no from 1 on. A copy_no of
    `docs` is replaced; all other columns stay."""
    nested = docs.select(F.struct(*[c for c in docs.columns if c != "copy_no"]).alias("mix_row"), id_col, "text", "source")
    rows = mix_rates(nested, cap, seed, id_col).where("mix_copies > 0")
    return rows.select("mix_row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy_no"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = mix_rates(docs)
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def mixing_sql(table: str, cap: int = CAP, seed: str = "mix") -> str:
    """The rates over `table` as DuckDB SQL: doc_id, size, source_size, target, copies."""
    return rf"""
    WITH sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {table}),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::BIGINT AS weight FROM sums),
    reached AS (SELECT *, (source_size * {cap})::DOUBLE / weight AS reach FROM ranked),
    run AS (SELECT *, sum(source_size) OVER () AS total,
            sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight,
            coalesce(sum(source_size) OVER o, 0) * {cap} AS closed
        FROM reached WINDOW o AS (ORDER BY reach, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    filled AS (SELECT *, (total - closed)::DOUBLE / open_weight::DOUBLE AS lev FROM run),
    goal AS (SELECT source, source_size,
            least((source_size * {cap})::DOUBLE, coalesce(weight * (SELECT min_by(lev, reach) FROM filled WHERE reach > lev), 'inf'::DOUBLE)) AS target
        FROM filled),
    rated AS (SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate
        FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
    SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < rate - floor(rate)
            THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM rated"""


OP3_SQL = f"SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM ({mixing_sql('documents')})"
