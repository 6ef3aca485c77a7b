"""Queries of scans over files, and of the lines that sinks write: files of a hundred records each, made from the
driver's tables in a shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.plans.base import query
from curatrix.sources import cameras, record_files, records
from curatrix.sources.shared import shared_path

C = F.col
PART = "p_partkey int, p_name string, p_size int"
model = lambda: F.floor(C("p_partkey") / 100).alias("model")


def _files(rows, key: str, line: str, sep: str = "\n", head: str = "", tail: str = ""):
    """(value): the lines of each key in order, as one text."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line))), lambda s: s[line]), sep)
    return rows.groupBy(key).agg(F.concat(F.lit(head), said, F.lit(tail)).alias("value"))


def _text_files(files) -> str:
    """A folder with a file for each key of files (key, value)."""
    path = shared_path(files.sparkSession, "texts")
    files.write.partitionBy(files.columns[0]).text(path)
    return path


def _json(get):
    return get.spread("part").select(model(), "p_partkey", F.to_json(F.struct("p_partkey", "p_name", "p_size")).alias("line"))


@query("SELECT p_partkey::INT AS p_partkey, p_name, p_size FROM part")
def s01_json_arrays(get):
    """Arrays of a hundred records, each file one line."""
    return records.read_json(get.spark, _text_files(_files(_json(get), "model", "line", ",", "\n [", "]")), PART)


@query("SELECT p_partkey::INT AS p_partkey, p_name, p_size FROM part")
def s02_json_lines(get):
    return records.parsed(_json(get).select(C("line").alias("value")), PART)


@query("SELECT p_partkey::INT AS p_partkey, p_name, p_size FROM part WHERE (p_partkey // 100) % 3 <> 2")
def s03_sniffed_json(get):
    """Files of arrays, of lines, and of what is neither, side by side."""
    rows = _json(get)
    arrays = _files(rows.where("model % 3 = 0"), "model", "line", ",", "[", "]")
    lines = _files(rows.where("model % 3 = 1"), "model", "line")
    path = _text_files(arrays.union(lines).union(rows.where("model % 3 = 2").select("model", F.lit("no record")).distinct()))
    return records.read_json(get.spark, path, PART, mode="DROPMALFORMED")


@query("SELECT row_id::VARCHAR AS image_file, edited_object, CASE WHEN row_id % 3 = 0 THEN NULL ELSE 'v' || row_id END AS visual_input FROM {instr}")
def s06_named_records(get):
    """Flat records under both names of the edited object, with the text None for a picture that there isn't."""
    visual = F.when(C("row_id") % 3 == 0, "None").otherwise(F.concat(F.lit("v"), C("row_id").cast("string")))
    one, other = (F.when(C("row_id") % 2 == k, C("edited_object")) for k in (0, 1))
    made = get("instr").select(F.to_json(F.struct(C("row_id").cast("string").alias("image_file"), one.alias("edited object"), other.alias("edit object"), visual.alias("visual_input"))).alias("value"))
    return records.named_records(records.parsed(made, records.RECORD)).select("image_file", "edited_object", "visual_input")


@query("SELECT 'p/' || p_name AS item, (p_partkey - 1) % 100 AS pos FROM part WHERE (p_partkey - 1) % 100 >= 5 AND (p_partkey - 1) % 100 < 45")
def s21_list_slices(get):
    rows = get("part").select(F.floor((C("p_partkey") - 1) / 100).alias("model"), "p_partkey", "p_name")
    return records.read_list(get.spark, _text_files(_files(rows, "model", "p_name")), "p/", 5, 40).select("item", "pos")


_number = lambda c: C(c).cast("double")


def _images(get):
    xys = F.transform(F.sequence(F.lit(1), C("p_size") % 4 + 1), lambda i: F.struct((C("p_size") * 0.5).alias("x"), i.cast("double").alias("y")))
    ids = F.transform(F.sequence(F.lit(1), C("p_size") % 4 + 1), lambda i: F.when(i == 1, F.lit(-1).cast("long")).otherwise(C("p_partkey") + i))
    rows = get.spread("part").select(
        model(), "p_partkey", C("p_partkey").cast("int").alias("image_id"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("qvec"), F.array(F.lit(0.5), _number("p_size"), F.lit(2.0)).alias("tvec"),
        C("p_size").alias("camera_id"), F.concat("p_name", F.lit(".jpg")).alias("name"), xys.alias("xys"), ids.alias("point3d_ids"))
    return rows.withColumn("name", F.replace("name", F.lit(" "), F.lit("_")))


_IMAGES = """SELECT p_partkey::INT AS image_id, p_size::DOUBLE AS tx, p_size AS camera_id, replace(p_name, ' ', '_') || '.jpg' AS name, p_size % 4 + 1 AS seen, (p_size * 0.5 * (p_size % 4 + 1))::DOUBLE AS xs,
    (-1 + p_partkey * (p_size % 4) + (p_size % 4 + 1) * (p_size % 4 + 2) // 2 - 1)::BIGINT AS points FROM part"""


def _seen(rows):
    zero = F.lit(0).cast("long")
    return rows.select("image_id", C("tvec")[1].alias("tx"), "camera_id", "name", F.size("xys").alias("seen"), F.aggregate("xys", F.lit(0.0), lambda s, p: s + p["x"]).alias("xs"), F.aggregate("point3d_ids", zero, lambda s, i: s + i).alias("points"))


@query(_IMAGES)
def s15_image_texts(get):
    """Images from texts of two lines a record, written as the text sink writes them."""
    rows = _images(get)
    lines = rows.select("model", "p_partkey", cameras.image_line().alias("line"))
    return _seen(cameras.read_images_text(get.spark, _text_files(_files(lines, "model", "line", head="# images\n"))))


def _written_and_read(rows, kind: str):
    """Records by way of binary files, read in ranges of 8 KB."""
    path = shared_path(rows.sparkSession, kind)
    record_files.write_records(rows, path, kind)
    return record_files.read_records(rows.sparkSession, path, kind, range_bytes=1 << 13)


@query(_IMAGES)
def s16_image_bytes(get):
    return _seen(_written_and_read(_images(get).drop("p_partkey"), "images"))


@query("SELECT p_partkey::INT AS camera_id, CASE WHEN p_size % 2 = 0 THEN 'PINHOLE' ELSE 'SIMPLE_PINHOLE' END AS model, (p_size * 10)::BIGINT AS width, (CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END * p_size)::DOUBLE AS params FROM part")
def s14_camera_bytes(get):
    even = C("p_size") % 2 == 0
    params = F.array_repeat(_number("p_size"), F.when(even, 4).otherwise(3))
    rows = get("part").select(C("p_partkey").cast("int").alias("camera_id"), F.when(even, "PINHOLE").otherwise("SIMPLE_PINHOLE").alias("model"), (C("p_size") * 10).cast("long").alias("width"), F.lit(480).cast("long").alias("height"), params.alias("params"))
    back = _written_and_read(rows, "cameras")
    return back.select("camera_id", "model", "width", F.aggregate("params", F.lit(0.0), lambda s, x: s + x).alias("params"))


@query("SELECT p_partkey AS point_id, p_size::DOUBLE AS x, p_size AS red, p_size % 3 AS seen, CASE WHEN p_size % 3 = 0 THEN 0 ELSE (p_size % 3) * p_size END::BIGINT AS images FROM part")
def s18_point_bytes(get):
    track = F.array_repeat(C("p_size"), C("p_size") % 3)
    rows = get("part").select(C("p_partkey").alias("point_id"), F.array(_number("p_size"), F.lit(2.0), F.lit(3.0)).alias("xyz"), F.array("p_size", F.lit(20), F.lit(30)).alias("rgb"), F.lit(0.5).alias("error"), track.alias("image_ids"), track.alias("point2d_idxs"))
    back = _written_and_read(rows, "points3D")
    return back.select("point_id", C("xyz")[0].alias("x"), C("rgb")[0].alias("red"), F.size("image_ids").alias("seen"), F.aggregate("image_ids", F.lit(0).cast("long"), lambda s, i: s + i).alias("images"))


@query("""SELECT p_partkey, concat('{"p_partkey":', p_partkey, ',"p_name":"', p_name, '","p_size":', p_size, '}') AS line, concat(p_partkey, ',', p_name, ',', p_size) AS csv FROM part""")
def k02_k05_lines(get):
    """The lines that the JSON and the CSV sink write."""
    row = F.struct("p_partkey", "p_name", "p_size")
    return get("part").select("p_partkey", F.to_json(row).alias("line"), F.to_csv(row).alias("csv"))
