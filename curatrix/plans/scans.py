"""Queries of the parsing steps behind the scans, over lines and objects made from the driver's tables, and of the
incremental steps over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions.sampling import pick
from curatrix.plans.base import query
from curatrix.sources import cameras
from curatrix.streaming import incremental

C = F.col
text = lambda *cols: F.concat_ws(" ", *[c.cast("string") for c in cols])
seconds = lambda c: F.unix_seconds(C(c)).alias(c)


def _camera_lines(get):
    wide = F.when(C("p_size") % 2 == 0, text(C("p_partkey"), F.lit("PINHOLE"), C("p_size") * 10, C("p_size") * 8, C("p_size"), C("p_size") + 1, F.lit(3), F.lit(4)))
    return get.spread("part").select(F.when(C("p_size") % 7 == 0, F.lit("# comment")).otherwise(wide.otherwise(text(C("p_partkey"), F.lit("SIMPLE_PINHOLE"), C("p_size") * 10, C("p_size") * 8, C("p_size"), F.lit(2), F.lit(3)))).alias("value"))


@query("SELECT p_partkey::INT AS camera_id, CASE WHEN p_size % 2 = 0 THEN 'PINHOLE' ELSE 'SIMPLE_PINHOLE' END AS model, (p_size * 10)::BIGINT AS width, CASE WHEN p_size % 2 = 0 THEN p_size * 2 + 8.0 ELSE p_size + 5.0 END::DOUBLE AS params FROM part WHERE p_size % 7 <> 0")
def s13_camera_lines(get):
    rows = cameras.cameras_of(_camera_lines(get))
    return rows.select("camera_id", "model", "width", F.aggregate("params", F.lit(0.0), lambda s, x: s + x).alias("params"))


@query("SELECT count(*) AS n FROM part WHERE p_size % 7 <> 0")
def k07_camera_round_trip(get):
    """Cameras that come back unchanged from the lines they are written as."""
    first = cameras.cameras_of(_camera_lines(get))
    again = cameras.cameras_of(cameras.camera_lines(first))
    return first.join(again, [c for c in first.columns if c != "params"]).where(first["params"] == again["params"]).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS point_id, p_size::DOUBLE AS x, 20 AS green, (p_partkey % 3)::INT AS seen, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE (p_partkey % 3) * 7 END::BIGINT AS images FROM part")
def s17_point_lines(get):
    track = F.array_join(F.flatten(F.array_repeat(F.array(F.lit("7"), F.lit("1")), (C("p_partkey") % 3).cast("int"))), " ")
    lines = get("part").select(F.trim(F.concat_ws(" ", text(C("p_partkey"), C("p_size"), F.lit(2), F.lit(3), F.lit(10), F.lit(20), F.lit(30), F.lit(0.5)), track)).alias("value"))
    rows = cameras.points_of(lines)
    return rows.select("point_id", C("xyz")[0].alias("x"), C("rgb")[1].alias("green"), F.size("point2d_idxs").alias("seen"), F.aggregate("image_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("images"))


@query("SELECT p_partkey::INT AS image_id, 0.5::DOUBLE AS qw, p_size::DOUBLE AS tx, 'img.jpg' AS name FROM part WHERE p_partkey % 4 <> 0")
def s20_pose_lines(get):
    whole = text(C("p_partkey"), F.lit(0.5), F.lit(0.1), F.lit(0.2), F.lit(0.3), C("p_size"), F.lit(2), F.lit(3), F.lit(1), F.lit("img.jpg"))
    rows = cameras.poses_of(get("part").select(F.when(C("p_partkey") % 4 == 0, F.lit("short line")).otherwise(whole).alias("value")))
    return rows.select("image_id", C("quat")[3].alias("qw"), C("tvec")[0].alias("tx"), "name")


@query("SELECT p_partkey AS key, lower([p_name, p_type][1 + ('0x' || substr(md5('caption|' || p_partkey), 1, 8))::BIGINT % 2]) AS caption FROM part")
def s04_keyed_captions(get):
    return get("part").select(C("p_partkey").alias("key"), F.lower(pick(F.array("p_name", "p_type"), C("p_partkey"), "caption")).alias("caption"))


@query("SELECT p_partkey, p_name AS text FROM part WHERE p_size % 3 = 0")
def s05_first_annotation(get):
    """Objects whose first annotation is in Latin script, from their JSON."""
    script = F.when(C("p_size") % 3 == 0, "Latin").otherwise("Thai")
    notes = F.when(C("p_size") % 5 == 1, F.lit(None)).otherwise(F.array(F.struct(script.alias("language"), C("p_name").alias("text")), F.struct(F.lit("Latin").alias("language"), F.lit("x").alias("text"))))
    notes = F.when(C("p_size") % 3 == 0, F.array(F.struct(F.lit("Latin").alias("language"), C("p_name").alias("text")))).otherwise(notes)
    made = get("part").select("p_partkey", F.to_json(F.struct(notes.alias("annotations"))).alias("j"))
    read = made.select("p_partkey", F.from_json("j", "annotations array<struct<language: string, text: string>>").alias("r"))
    first = F.get("r.annotations", F.lit(0))
    return read.where(first["language"] == "Latin").select("p_partkey", first["text"].alias("text"))


@query("SELECT p_partkey, p_name AS concept, concat(p_type, ', ', p_size) AS caption FROM part")
def s08_split_at_first_comma(get):
    both = F.split(F.concat_ws(",", "p_name", F.concat("p_type", F.lit(", "), C("p_size").cast("string"))), ",", 2)
    return get("part").select("p_partkey", both[0].alias("concept"), both[1].alias("caption"))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def extension_tumbling_windows(get):
    return incremental.tumbling(get("events")).select(seconds("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def extension_sessions(get):
    return incremental.sessions(get("events")).select("user_id", seconds("start"), "n")
