"""Queries of total orders, unions, nested fields, turns, errors of single rows, and what sinks write."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from curatrix.functions import boxes as bx
from curatrix.functions import scorers
from curatrix.functions import text as t
from curatrix.functions import vector as v
from curatrix.functions.sampling import draw
from curatrix.operators import relational as rel
from curatrix.operators import rules as r
from curatrix.operators import vision
from curatrix.plans.base import query
from curatrix.sources import records

C = F.col

# --------------------------------------------------------------------------- orders and unions


@query("""WITH p AS (SELECT a.vec_id AS first, b.vec_id AS second, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT first, second, similarity, row_number() OVER (ORDER BY similarity DESC, first) - 1 AS position FROM p""")
def o01_by_similarity(get):
    """Pairs in descending order of similarity, in one order over all partitions."""
    x = get("embeddings").select(C("vec_id").alias("first"), C("embedding").alias("a"))
    y = x.select((C("first") - 1).alias("first"), C("first").alias("second"), C("a").alias("b"))
    rows = x.join(y, "first").select("first", "second", F.round(v.cosine(C("a"), C("b")), 6).alias("similarity"))
    rows = rel.numbered(rows.withColumn("down", -C("similarity")), ["down", "first"], 1)
    return rows.select("first", "second", "similarity", "position")


@query("""WITH w AS (SELECT p_partkey AS pos, split_part(p_name, ' ', 2) AS word FROM part), n AS (SELECT word, count(*) AS n, min(pos) AS first FROM w GROUP BY 1)
    SELECT word, n, row_number() OVER (ORDER BY n, first) - 1 AS position FROM n""")
def o02_rarest_first(get):
    """Words by how often they are there, and where equal by where they are there first."""
    n = get("part").select(C("p_partkey").alias("pos"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return rel.numbered(n, ["n", "first"], 1).select("word", "n", "position")


@query("SELECT image_file, row_number() OVER (ORDER BY image_file) - 1 AS position FROM {instr}")
def o04_paths_in_order(get):
    return rel.numbered(get("instr").select("image_file"), ["image_file"], 1).select("image_file", "position")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u01_concatenated(get):
    """Tables below each other, by the names of their columns; what one lacks is null."""
    a = get("customer").select(C("c_custkey").alias("id"), C("c_name").alias("name"), C("c_mktsegment").alias("segment"))
    return a.unionByName(get("supplier").select(C("s_name").alias("name"), C("s_suppkey").alias("id")), allowMissingColumns=True)


@query("""SELECT row_id, concat(array_to_string(w[1:2], ' '), ' | ', array_to_string(w[3:5], ' '), ' | ', array_to_string(w[6:], ' ')) AS parts, array_to_string(w, ' ') AS whole
    FROM (SELECT row_id, string_split(input, ' ') AS w FROM {instr} WHERE input IS NOT NULL)""")
def u09_sliced_by_sizes(get):
    """Words in pieces of two, three and the rest, and put together again."""
    rows = get("instr").where("input is not null").select("row_id", F.split("input", " ").alias("w"))
    rows = rows.withColumn("s", t.slices(C("w"), F.array(F.lit(2), F.lit(3), F.size("w") - 5)))
    return rows.select("row_id", F.array_join(F.transform("s", lambda x: F.array_join(x, " ")), " | ").alias("parts"), F.array_join(F.flatten("s"), " ").alias("whole"))


@query("SELECT row_id, CASE WHEN edit_type = 'replace' THEN 'visual_reference' ELSE edit_type END AS edit_type, new_object IS NOT NULL AS had_object, to_json({'name': edit_type, 'text': edit})::VARCHAR AS j FROM {instr}")
def f37_renamed_and_dropped(get):
    """Fields of nested records renamed and dropped."""
    rows = get("instr").select("row_id", F.struct("edit_type", "edit", "new_object").alias("r"))
    kind = F.when(C("r.edit_type") == "replace", "visual_reference").otherwise(C("r.edit_type"))
    rows = rows.withColumns({"edit_type": kind, "had_object": C("r.new_object").isNotNull()})
    bare = C("r").withField("name", C("r.edit_type")).withField("text", C("r.edit")).dropFields("edit_type", "edit", "new_object")
    return rows.select("row_id", "edit_type", "had_object", F.to_json(bare).alias("j"))


# --------------------------------------------------------------------------- turns and errors

_KINDS = "['add', 'remove', 'replace', 'color_alter']"


def _h(k: int) -> str:
    return f"('0x' || substr(md5('turn{k}|' || row_id), 1, 8))::BIGINT"


_TURN = "CASE WHEN " + "{h} % 7 = 0 THEN NULL ELSE concat({kind}, ': ', edit) END"
_TURNS = [_TURN.format(h=_h(k), kind=f"{_KINDS}[1 + {_h(k)} % 4]" if k < 3 else f"[{_KINDS[1:-1]}, 'tone_transfer'][1 + {_h(k)} % 5]") for k in (1, 2, 3)]


@query(f"SELECT row_id, array_to_string([a, b, c], ' / ') AS history FROM (SELECT row_id, {_TURNS[0]} AS a, {_TURNS[1]} AS b, {_TURNS[2]} AS c FROM {{instr}}) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def d10_turns(get):
    """Sessions of three turns of which none failed; only the last may change the tone."""
    turns = get("instr").select("row_id", "edit", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    h = C("k").cast("string")
    h = F.conv(F.substring(F.md5(F.concat(F.lit("turn"), h, F.lit("|"), C("row_id").cast("string"))), 1, 8), 16, 10).cast("long")
    many = F.when(C("k") == 3, 5).otherwise(4)
    kinds = F.array(*map(F.lit, ("add", "remove", "replace", "color_alter", "tone_transfer")))
    turns = turns.withColumn("made", F.when(h % 7 != 0, F.concat(F.get(kinds, (h % many).cast("int")), F.lit(": "), "edit")))
    done = r.sessions(turns.select("row_id", "k", "made"), "row_id", "k", F.lit(""), lambda state, turn: turn["made"]).where("done")
    return done.select("row_id", F.array_join("history", " / ").alias("history"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text, ('0x' || substr(md5('fails|' || conv_id || '|' || turn), 1, 8))::BIGINT % 9 = 0 AS fails FROM conversations),
    s AS (SELECT conv_id, 0::BIGINT AS k, '' AS said, '' AS history, true AS ok FROM (SELECT DISTINCT conv_id FROM t)
        UNION ALL SELECT t.conv_id, t.k, left(md5(said || text), 8), history || CASE WHEN t.k > 1 THEN ' / ' ELSE '' END || left(md5(said || text), 8), NOT fails FROM s JOIN t ON t.conv_id = s.conv_id AND t.k = s.k + 1 WHERE ok)
    SELECT conv_id, count(*) FILTER (ok AND k > 0) AS turns, max_by(history, k) FILTER (ok) AS history, bool_and(ok) AS done FROM s GROUP BY 1""")
def d10_sessions(get):
    """Sessions of as many turns as the conversation has: each turn goes on from what the one before gave, and a failed one
    ends the session."""
    fails = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("fails"), C("conv_id").cast("string"), C("turn").cast("string"))), 1, 8), 16, 10).cast("long") % 9 == 0
    turns = get("conversations").select("conv_id", "turn", "text", fails.alias("fails"))
    step = lambda state, turn: F.when(~turn["fails"], F.left(F.md5(F.concat(state, turn["text"])), F.lit(8)))
    rows = r.sessions(turns, "conv_id", "turn", F.lit(""), step)
    return rows.select("conv_id", F.size("history").cast("long").alias("turns"), F.array_join("history", " / ").alias("history"), "done")


@query("SELECT event_id, CASE WHEN user_id % 5 > 0 THEN floor(1000 / (user_id % 5)) END::DOUBLE AS share, CASE WHEN user_id % 5 = 0 THEN 'ZeroDivisionError' END AS share_error FROM events")
def d11_isolated_errors(get):
    """A row that fails keeps its error, and costs no other row its value."""
    rows = get("events").select("event_id", (C("user_id") % 5).alias("k"))
    work = lambda x: pd.Series([float(1000 // k) for k in x["k"].tolist()])
    return scorers.scored(rows, [scorers.isolated("share", work, ["k"])]).select("event_id", "share", "share_error")


# --------------------------------------------------------------------------- what sinks write


@query("""SELECT id // 10 AS image, id % 10 AS id, c1 + c3 AS area, id % 7 AS bbox_x0, id % 5 AS bbox_y0, 8 AS bbox_w, 8 AS bbox_h, (id % 3 + 0.5)::DOUBLE AS point_input_x, 0.5::DOUBLE AS point_input_y, 0.9::DOUBLE AS predicted_iou, 0.95::DOUBLE AS stability_score,
    0 AS crop_box_x0, 0 AS crop_box_y0, 512 AS crop_box_w, 512 AS crop_box_h FROM {masks}""")
def k08_mask_metadata(get):
    numbers = lambda *x: F.array(*[F.lit(i) if isinstance(i, int) else i for i in x])
    rows = get("masks").select(
        F.floor(C("id") / 10).alias("image"), (C("id") % 10).alias("id"), bx.rle_area(F.array("c0", "c1", "c2", "c3", "c4")).alias("area"), numbers(C("id") % 7, C("id") % 5, 8, 8).alias("bbox"),
        F.array(C("id") % 3 + F.lit(0.5), F.lit(0.5)).alias("point"), F.lit(0.9).alias("predicted_iou"), F.lit(0.95).alias("stability_score"), numbers(0, 0, 512, 512).alias("crop_box"))
    return records.mask_metadata(rows)


@query("SELECT row_id, concat('out/', edit_type, '/input_img/', row_id, '.jpg') AS input_img, concat('out/', edit_type, '/mask/', row_id, '.jpg') AS mask FROM {instr}")
def k09_output_paths(get):
    p = records.output_paths(F.lit("out"), C("edit_type"), F.concat(C("row_id").cast("string"), F.lit(".jpg")))
    return get("instr").select("row_id", p["input_img"].alias("input_img"), p["mask"].alias("mask"))


@query("""SELECT key, CASE WHEN len(v) = 1 THEN v[1] END AS value, array_to_string(v, ' ') AS whole FROM (SELECT p_brand AS key, max_by(string_split(concat(p_type, CASE WHEN p_size % 2 = 0 THEN concat(' ', p_size) ELSE '' END), ' '), p_partkey) AS v FROM part GROUP BY 1)""")
def s22_last_of_key(get):
    item = F.concat("p_brand", F.lit(" "), "p_type", F.when(C("p_size") % 2 == 0, F.concat(F.lit(" "), C("p_size").cast("string"))).otherwise(""))
    rows = records.dict_of(get("part").select(C("p_partkey").alias("pos"), item.alias("item")))
    return rows.select("key", "value", F.array_join("values", " ").alias("whole"))


@query("""WITH i AS (SELECT n_nationkey AS image_id, n_nationkey * 40 + 300 AS w, 400 AS h FROM nation), l AS (SELECT *, layer, (2 ** layer)::BIGINT AS per, floor(least(w, h) * (512 / 1500) * 2 / (2 ** layer))::BIGINT AS over FROM i, (SELECT unnest(range(3)) AS layer)),
    c AS (SELECT *, ceil((over * (per - 1) + w) / per)::BIGINT AS cw, ceil((over * (per - 1) + h) / per)::BIGINT AS ch FROM l), g AS (SELECT *, unnest(range(per)) AS i FROM c), b AS (SELECT *, unnest(range(per)) AS j FROM g)
    SELECT image_id, layer::INT AS layer, CASE WHEN layer = 0 THEN 0 ELSE (cw - over) * i END AS x0, CASE WHEN layer = 0 THEN 0 ELSE (ch - over) * j END AS y0,
        CASE WHEN layer = 0 THEN w ELSE least((cw - over) * i + cw, w) END AS x1, CASE WHEN layer = 0 THEN h ELSE least((ch - over) * j + ch, h) END AS y1 FROM b""")
def g13_crop_boxes(get):
    return vision.crop_boxes(get("nation").select(C("n_nationkey").alias("image_id"), (C("n_nationkey") * 40 + 300).alias("w"), F.lit(400).alias("h")), 2)
