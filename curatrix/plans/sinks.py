"""Queries of sinks and of scans over real files, which they make from the driver's tables in a shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import relational as rel
from curatrix.plans.base import query
from curatrix.plans.files import _images
from curatrix.sources import cameras, records
from curatrix.sources.shared import shared_path
from curatrix.streaming import incremental

C = F.col
_ENDS = "['.jpg', '.PNG', '.txt', '.jpeg'][1 + s_suppkey % 4]"


def _stem():
    return F.concat(F.lit("s"), C("s_suppkey").cast("string"))


def _folder(get) -> str:
    """A folder with a file for each supplier, of which three in four are named as images are."""
    path = shared_path(get.spark, "images")
    end = F.get(F.array(*map(F.lit, (".jpg", ".PNG", ".txt", ".jpeg"))), (C("s_suppkey") % 4).cast("int"))
    records.write_named(get("supplier").select(F.concat(_stem(), end).alias("name"), F.lit("x").alias("text")), path)
    return path


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def s07_csv_tables(get):
    path = shared_path(get.spark, "csv")
    records.write_csv(get("part").select("p_partkey", "p_name", "p_retailprice"), path)
    return records.read_csv(get.spark, path, "p_partkey long, p_name string, p_retailprice double")


@query(f"SELECT name, row_number() OVER (ORDER BY name) - 1 AS position FROM (SELECT 's' || s_suppkey || {_ENDS} AS name FROM supplier WHERE s_suppkey % 4 <> 2)")
def s09_s11_listed_images(get):
    """The files of a folder that are named as images are, by path."""
    return rel.numbered(records.list_images(get.spark, _folder(get)).select("path", "name"), ["path"], 1).select("name", "position")


@query("SELECT s_name || ' one' AS caption FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0")
def s10_sidecar_captions(get):
    """Images with the first line of the text of the same stem; those without one are out."""
    texts = shared_path(get.spark, "texts")
    said = get("supplier").where("s_suppkey % 3 <> 0").select(F.concat(_stem(), F.lit(".txt")).alias("name"), F.concat("s_name", F.lit(" one\ntwo")).alias("text"))
    records.write_named(said, texts)
    return records.read_sidecars(get.spark, _folder(get), texts).select("caption")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0")
def s12_existing_files(get):
    path = _folder(get)
    rows = get("supplier").select("s_suppkey", F.concat(F.lit(f"{path}/"), _stem(), F.lit(".jpg")).alias("file"))
    return records.existing(rows, "file", records.list_files(get.spark, path)).select("s_suppkey")


@query("""SELECT p_partkey::INT AS image_id, p_partkey + i AS point_id, (p_size * 0.5)::DOUBLE AS x, i::DOUBLE AS y FROM (SELECT *, unnest(range(2, p_size % 4 + 2)) AS i FROM part) WHERE p_partkey + i IN (SELECT p_partkey FROM part)""")
def s19_k07_model_of_either_format(get):
    """A model written as text, and over it as binary files: what is read is the binary one, and its images meet its
    points."""
    images, path = _images(get).drop("model", "p_partkey"), shared_path(get.spark, "model")
    cams = get("part").select(C("p_partkey").cast("int").alias("camera_id"), F.lit("SIMPLE_PINHOLE").alias("model"), F.lit(8).cast("long").alias("width"), F.lit(8).cast("long").alias("height"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("params"))
    points = get("part").select(C("p_partkey").alias("point_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("xyz"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("rgb"), F.lit(0.5).alias("error"), F.array("p_size").alias("image_ids"), F.array("p_size").alias("point2d_idxs"))
    cameras.write_model_text(cams.limit(0), images.limit(0), points.limit(0), path)
    cameras.write_model_binary(cams, images, points, path)
    _, seen, known = cameras.read_model(get.spark, path)
    return cameras.observations(seen, known)


@query("""SELECT 's' || s_suppkey || '.jpg' AS filename, 's' || s_suppkey || '.png' AS seg_map, false AS listed FROM supplier WHERE s_suppkey % 4 = 0
    UNION ALL SELECT 's' || s_suppkey || '.jpg', NULL, true FROM supplier WHERE s_suppkey % 5 = 0""")
def s25_datasets(get):
    """Images of a folder with their annotations, and those that a list names, without."""
    names = shared_path(get.spark, "split")
    get("supplier").where("s_suppkey % 5 = 0").select(F.concat(_stem(), F.lit(" ")).alias("value")).write.text(names)
    found = records.read_dataset(get.spark, _folder(get), "annotations").withColumn("listed", F.lit(False))
    return found.union(records.read_dataset(get.spark, "unused", split=names).withColumn("listed", F.lit(True)))


@query("SELECT edit_type, CASE WHEN price > 1200 THEN 'selected' ELSE 'failed' END AS verdict, count(*) AS n, sum(row_id)::BIGINT AS ids FROM {instr} GROUP BY 1, 2")
def k04_routed_by_selection(get):
    path = shared_path(get.spark, "selected")
    records.write_selected(get("instr").select("row_id", "edit_type", (C("price") > 1200).alias("selected")), path)
    rows = get.spark.read.schema("row_id long, edit_type string, verdict string").json(path)
    return rows.groupBy("edit_type", "verdict").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def k05_appended_csv(get):
    """Orders in two appends; every file has its header, and readers take it as such."""
    path = shared_path(get.spark, "appended")
    rows = get("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for k in (0, 1):
        records.write_csv(rows.where(F.pmod("o_orderkey", F.lit(2)) == k), path)
    return records.read_csv(get.spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def k06_d09_resumed_run(get):
    """Events that come in two parts: a second run takes what is new since its checkpoint."""
    source, sink, mark = (shared_path(get.spark, x) for x in ("source", "sink", "mark"))
    rows = get("events")
    for k in (0, 1):
        rows.where(C("event_id") % 3 == 0 if k else C("event_id") % 3 != 0).write.mode("append").parquet(source)
        incremental.run_once(get.spark, source, rows.schema, lambda d: d.select("event_id", "event_type"), sink, mark)
    return get.spark.read.parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT c_custkey, c_custkey % 4 = 0 AS first FROM customer")
def k10_appended_once(get):
    """What an interrupted job wrote stays; the next one appends the rest."""
    path, rows = shared_path(get.spark, "appended"), get("customer").select("c_custkey")
    mark = lambda first: rows.withColumn("first", F.lit(first))
    records.append_new(mark(True).where("c_custkey % 4 = 0"), path, "c_custkey")
    records.append_new(mark(False), path, "c_custkey", get.spark.read.parquet(path))
    return get.spark.read.parquet(path)
