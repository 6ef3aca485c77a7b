"""Inputs in the shapes that the curation steps take, made from the driver's tables. The texts are SQL that Spark and
DuckDB both read, so that a query and its oracle start from equal rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NARROW_BYTES, WIDE_BYTES = 1 << 18, 16 << 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHAPES = {
    # instruction records, one per part
    "instr": """SELECT p_partkey AS row_id,
        CASE p_partkey % 9 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'replace' WHEN 3 THEN 'color_alter' WHEN 4 THEN 'action_change'
            WHEN 5 THEN 'background_change' WHEN 6 THEN 'tone_transfer' WHEN 7 THEN 'textual' ELSE 'appearance_alter' END AS edit_type,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS edited_object,
        CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'painter' WHEN p_partkey % 17 = 0 THEN 'young woman' ELSE concat(lower(p_type), ' box') END AS new_object,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('a ', lower(p_type), CASE WHEN p_partkey % 3 = 0 THEN ' table' ELSE ' beach' END) END AS new_background,
        CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('a ', p_name, ' on the table, near a ', lower(p_type), ' wall.') END AS input,
        CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE concat('a ', p_name, ' on the ', lower(p_type), ', near a red wall.') END AS output,
        CASE WHEN p_partkey % 10 = 7 THEN concat('Change ''', p_name, ''' into ''', lower(p_type), '''') WHEN p_partkey % 10 = 3 THEN concat('remove the ', p_name)
            WHEN p_partkey % 10 = 5 THEN concat('make the ', p_name, ' bigger in color') ELSE concat('turn the ', p_name, ' to ', CASE WHEN p_partkey % 6 = 0 THEN 'woman' ELSE 'red' END) END AS edit,
        concat('imgs/run_', CAST(p_partkey % 3 AS STRING), '/COCO_train2014_', lpad(CAST(p_partkey AS STRING), 6, '0'), '.jpg') AS image_file,
        p_size AS size, p_retailprice AS price
        FROM part""",
    # scores of those records
    "scores": """SELECT p_partkey AS row_id, CAST(p_partkey * 37 % 100 AS DOUBLE) / 100.0 AS clip, CAST(p_partkey * 53 % 20 AS DOUBLE) / 100.0 AS clip_dir, CAST(p_partkey * 29 % 100 AS DOUBLE) / 100.0 AS l1,
        CASE p_partkey % 4 WHEN 0 THEN 'yes it is' WHEN 1 THEN 'no' WHEN 2 THEN 'That is right' ELSE 'Yes' END AS vqa_answer,
        concat('sign ', p_name) AS ocr_src, concat('now ', lower(p_type)) AS ocr_dst, p_partkey % 3 = 0 AS detected, p_partkey % 10 <> 9 AS detected_new
        FROM part""",
    # detections, one per line item; images are orders
    "boxes": """SELECT CAST(l_orderkey AS BIGINT) AS image_id, CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT) AS box_id,
        l_quantity * 8.0 AS x0, l_discount * 3000.0 AS y0, l_quantity * 8.0 + 20.0 + l_linenumber * 25.0 AS x1, l_discount * 3000.0 + 30.0 + l_tax * 1500.0 AS y1,
        CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS DOUBLE) / 1000.0 AS score, CASE l_linenumber WHEN 1 THEN 'dog' WHEN 2 THEN 'red dog' WHEN 3 THEN 'cat' ELSE 'park bench' END AS phrase
        FROM lineitem""",
    # captions of two clauses that say what a thing does, with an edit to do something else
    "acts": """SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN 'action_change' ELSE 'add' END AS edit_type,
        concat('make it to ', CASE p_partkey % 6 WHEN 0 THEN 'run' WHEN 1 THEN 'jump' WHEN 2 THEN 'be' WHEN 3 THEN 'sit' WHEN 4 THEN 'eating' ELSE 'having' END, ' now') AS edit,
        concat('a ', p_name, CASE p_size % 3 WHEN 0 THEN ' runs' WHEN 1 THEN ' stands' ELSE ' sits' END, ' here, it ', CASE p_partkey % 4 WHEN 0 THEN 'jumps' WHEN 1 THEN 'waits' WHEN 2 THEN 'eats' ELSE 'is red' END, ' there, near a wall.') AS input,
        concat('a ', p_name, CASE p_size % 4 WHEN 0 THEN ' runs' WHEN 1 THEN ' stands' WHEN 2 THEN ' jumping' ELSE ' sits' END, ' here, it ', CASE p_partkey % 5 WHEN 0 THEN 'eats' WHEN 1 THEN 'jumps' WHEN 2 THEN 'waits' WHEN 3 THEN 'run' ELSE 'sitting' END, ' there.') AS output,
        CASE p_partkey % 5 WHEN 0 THEN 'red women' WHEN 1 THEN 'two cats' WHEN 2 THEN 'painters' WHEN 3 THEN 'teachers' ELSE p_name END AS new_object,
        concat('a table with ', CASE p_partkey % 10 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN 'two' WHEN 3 THEN '3' WHEN 4 THEN 'seven' WHEN 5 THEN 'nine' WHEN 6 THEN 'many' WHEN 7 THEN 'one' WHEN 8 THEN '5' ELSE 'ten' END, ' ', split_part(p_name, ' ', 2), 's and ',
            CASE p_size % 4 WHEN 0 THEN 'four' WHEN 1 THEN '8' WHEN 2 THEN 'some' ELSE 'three' END, ' chairs') AS caption, concat(split_part(p_name, ' ', 2), 's') AS noun,
        concat('# sky', CASE WHEN p_size % 3 = 0 THEN ', location=''in the center''' ELSE '' END, chr(10), chr(10), '# ', p_name, CASE WHEN p_size % 5 = 0 THEN ', location=''in the center''' ELSE ', location=''on the left''' END,
            CASE WHEN p_partkey % 2 = 0 THEN concat(chr(10), chr(10), '# third') ELSE '' END, CASE WHEN p_partkey % 4 = 0 THEN concat(chr(10), chr(10), '# fourth, location=''in the center''') ELSE '' END) AS layout
        FROM part""",
    # a meter's series, one per event type
    "meter": "SELECT event_type AS name, event_id AS seq, value, CAST(user_id % 5 + 1 AS INT) AS n FROM events",
    # pixels of predicted and true classes
    "pixels": "SELECT CAST(user_id AS INT) % 7 AS pred, CASE WHEN event_id % 13 = 0 THEN 255 WHEN event_id % 3 = 0 THEN CAST(user_id AS INT) % 7 ELSE CAST(event_id AS INT) % 6 END AS label FROM events",
    # short run-length masks of 8 rows by 8 columns
    "masks": """SELECT p_partkey AS id, 8 AS h, CAST(p_partkey % 9 AS BIGINT) AS c0, CAST(p_partkey % 5 AS BIGINT) AS c1, CAST(p_partkey % 11 AS BIGINT) AS c2, CAST(p_partkey % 6 AS BIGINT) AS c3,
        CAST(64 - p_partkey % 9 - p_partkey % 5 - p_partkey % 11 - p_partkey % 6 AS BIGINT) AS c4 FROM part""",
}


def spread(rows: DataFrame) -> DataFrame:
    """rows in parts of about NARROW_BYTES of their files, as many as the session's shuffle partitions; more if these
    were larger than WIDE_BYTES."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if hasattr(rows, "_jdf") else parts * NARROW_BYTES
    n = max(min(parts, math.ceil(size / NARROW_BYTES)), math.ceil(size / WIDE_BYTES))
    return rows.repartition(n) if n > 1 else rows


def shape(spark: SparkSession, sf_dir: str, name: str, dealt: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    text = SHAPES[name]
    table = text.rsplit("FROM ", 1)[1].split()[0]
    return spark.sql(text.replace(f"FROM {table}", "FROM {src}"), src=dealt(table_of(spark, sf_dir, table)))


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def spread(self, name: str) -> DataFrame:
        """The table or shape dealt over more tasks than its few groups of rows make, for work that is long by row."""
        if name not in SHAPES:
            return spread(self(name))
        return shape(self.spark, self.sf_dir, name, spread)

    def __call__(self, name: str) -> DataFrame:
        return (shape if name in SHAPES else table_of)(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Registers f(get), where get(name) gives a table or shape and get.spark the session, and its SQL, in which {name}
    stands for a shape."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            text = sql
            for k, v in SHAPES.items():
                text = text.replace("{" + k + "}", f"({v})")
            SQL[key] = text
        return f

    return add
