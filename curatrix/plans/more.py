"""Further queries: guards with scores, list functions, geometry decisions, prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.functions import align, raster, scorers
from curatrix.functions import boxes as bx
from curatrix.functions import text as t
from curatrix.functions import vector as v
from curatrix.operators import relational as rel
from curatrix.operators import rules as r
from curatrix.plans.base import query
from curatrix.sources.records import frame_positions

C = F.col
draw_of = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
R = lambda c, n=6: F.round(c, n)


# --------------------------------------------------------------------------- text and lists


@query("SELECT row_id, array_to_string(list_sort(string_split(input, ' ')), ' ') AS sorted FROM {instr}")
def o03_sorted_words(get):
    return get("instr").select("row_id", F.array_join(F.array_sort(F.split("input", " ")), " ").alias("sorted"))


@query("SELECT row_id, array_to_string(string_split(input, ' ')[1:3], ' ') AS head FROM {instr}")
def o11_first_regions(get):
    return get("instr").select("row_id", F.array_join(F.slice(F.split("input", " "), 1, 3), " ").alias("head"))


@query("SELECT event_id FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE event_type = 'purchase')")
def o09_skip_until_key(get):
    e = get("events").select("event_id", "event_type")
    first = e.where("event_type = 'purchase'").agg(F.min("event_id").alias("first"))  # one row
    return e.join(F.broadcast(first), C("event_id") >= C("first")).select("event_id")


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(trim(p_name)))), '|') AS names FROM part GROUP BY 1")
def a03_trimmed_union(get):
    return get("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(F.trim("p_name"))), "|").alias("names"))


@query("SELECT name, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM {meter} GROUP BY 1")
def a13_running_totals(get):
    return get("meter").groupBy("name").agg(F.count("*").alias("count"), R(F.sum("value"), 4).alias("total"), R(F.avg("value")).alias("mean"))


@query("SELECT round(avg(CASE WHEN abs(p.p_size - q.p_size) + abs(p.p_retailprice - q.p_retailprice) < 1e-4 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM part p JOIN part q ON q.p_partkey = p.p_partkey + p.p_partkey % 2")
def a20_row_equality(get):
    p = get("part").select("p_partkey", F.array(C("p_size").cast("double"), "p_retailprice").alias("a"))
    q = p.select(C("p_partkey").alias("k"), C("a").alias("b"))
    far = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return p.join(q, C("k") == C("p_partkey") + C("p_partkey") % 2).agg(R(F.avg((far < 1e-4).cast("double"))).alias("accuracy"))


@query("""SELECT name, seq, (sum(CAST(round(value * 100) AS BIGINT) * n) OVER w // sum(n) OVER w)::BIGINT AS mean_cents FROM {meter}
    WINDOW w AS (PARTITION BY name ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w04_last_n_mean(get):
    """Mean of the last five, weighted, in whole hundredths."""
    rows = rel.with_carried(rel.placed(get("meter"), ["name"], "seq"), 4)
    w = Window.partitionBy("name", "piece").orderBy("place").rowsBetween(-4, 0)
    rows = rows.select("name", "seq", "carried", F.sum(F.round(C("value") * 100).cast("long") * C("n")).over(w).alias("s"), F.sum("n").over(w).alias("k"))
    return rows.where("not carried").select("name", "seq", F.expr("s div k").alias("mean_cents"))


@query(r"""SELECT p_partkey, string_split(l, '; ')[1] AS caption, string_split(l, '; ')[4] AS keywords FROM (SELECT p_partkey, unnest(regexp_extract_all(concat('1. ', p_name, '; a; b; c', chr(10), '2. ', p_type, '; only two'), '[0-9]+\.? *(.*)', 1)) AS l FROM part) WHERE len(string_split(l, '; ')) >= 4""")
def p14_numbered_lines(get):
    text = F.concat(F.lit("1. "), "p_name", F.lit("; a; b; c\n2. "), "p_type", F.lit("; only two"))
    rows = get("part").select("p_partkey", F.explode(F.regexp_extract_all(text, F.lit(r"[0-9]+\.? *(.*)"), F.lit(1))).alias("l")).select("p_partkey", F.split("l", "; ").alias("f"))
    return rows.where(F.size("f") >= 4).select("p_partkey", C("f")[0].alias("caption"), C("f")[3].alias("keywords"))


@query("SELECT c_custkey, concat('sample', 100 + row_number() OVER (ORDER BY c_custkey)) AS name FROM customer")
def p15_sequential_keys(get):
    rows = rel.numbered(get("customer").select("c_custkey"), ["c_custkey"], 100)
    return rows.select("c_custkey", F.concat(F.lit("sample"), (C("position") + 101).cast("string")).alias("name"))


@query("""SELECT row_id, array_to_string(list_transform(string_split(concat(edited_object, ', big hat'), ', '), lambda k: CASE WHEN contains(k, ' ') AND contains(edit, string_split(k, ' ')[1]) THEN string_split(k, ' ')[1] ELSE k END), ', ') AS keywords
    FROM {instr} WHERE edited_object IS NOT NULL""")
def p17_keywords(get):
    def short(k):
        first = F.element_at(F.split(k, " "), 1)
        return F.when(F.contains(k, F.lit(" ")) & F.contains(C("edit"), first), first).otherwise(k)

    words = F.split(F.concat("edited_object", F.lit(", big hat")), ", ")
    return get("instr").where("edited_object is not null").select("row_id", F.array_join(F.transform(words, short), ", ").alias("keywords"))


@query("""WITH o AS (SELECT row_id, replace(edited_object, 'ring', 'balloon') AS o, replace(string_split(edit, ' ')[-1], 'red', 'left') AS w FROM {instr})
    SELECT row_id, CASE WHEN contains(o, 'ball') THEN 'ball' ELSE o END AS obj, CASE WHEN w NOT IN ('left', 'right', 'upper', 'down') THEN w END AS target FROM o""")
def p22_canonical(get):
    obj, target = r.canonical(F.replace("edited_object", F.lit("ring"), F.lit("balloon")), F.replace(t.last_word(C("edit")), F.lit("red"), F.lit("left")))
    return get("instr").select("row_id", obj.alias("obj"), target.alias("target"))


@query("SELECT row_id, replace(image_file, 'imgs/', 'edited/') AS edited_file FROM {instr}")
def p25_output_path(get):
    return get("instr").select("row_id", F.replace("image_file", F.lit("imgs/"), F.lit("edited/")).alias("edited_file"))


_TURN = """(SELECT row_id, row_id // 8 AS sequence, CASE WHEN (0.6 * a - 0.8 * c) * sign(0.6 * c + 0.8 * a) > 0 THEN 'left' ELSE 'right' END AS direction
    FROM (SELECT row_id, 2 * clip - 1 AS a, l1 AS b, 2 * clip_dir - 0.1 AS c FROM {scores}) WHERE 0.6 * c + 0.8 * a <> 0)"""


@query(f"""SELECT row_id, direction, k > 1 AS swapped, concat(['Turn', 'Make', 'Rotate'][1 + ('0x' || substr(md5('turn|' || row_id), 1, 8))::BIGINT % 3], ' the ', p_name,
    CASE WHEN (direction = 'right') = (k = 1) THEN ' clockwise' ELSE ' counterclockwise' END) AS edit
    FROM (SELECT *, row_number() OVER (PARTITION BY sequence, direction ORDER BY row_id) AS k FROM {_TURN}) JOIN part ON p_partkey = row_id""")
def p10_rotation_direction(get):
    """The turn between two orientations, q of the row and one that is fixed: left where its axis points up. The second
    turn of one direction in a sequence is told backwards, with its pictures swapped."""
    rows = get("scores").select("row_id", (2 * C("clip") - 1).alias("a"), C("l1").alias("b"), (2 * C("clip_dir") - 0.1).alias("c"))
    rows = rows.select("row_id", F.floor(C("row_id") / 8).alias("sequence"), v.relative_rotation(F.array(F.lit(0.6), F.lit(0.0), F.lit(0.8), F.lit(0.0)), F.array("c", "b", "a", F.lit(0.0))).alias("q"))
    rows = r.rotations(rows.where(C("q")[0] != 0).withColumn("direction", r.rotation_direction(C("q"))), "sequence", "row_id")
    rows = rows.join(get("part").select(C("p_partkey").alias("row_id"), "p_name"), "row_id")
    return rows.select("row_id", "direction", "swapped", r.rotation_edit(C("row_id"), C("p_name"), C("direction"), C("swapped")).alias("edit"))


@query("SELECT row_id, array_to_string(CASE WHEN list_contains(string_split(input, ' '), edited_object) THEN string_split(input, ' ') ELSE list_append(string_split(input, ' '), edited_object) END, ' ') AS tags FROM {instr} WHERE input IS NOT NULL AND edited_object IS NOT NULL")
def f30_append_if_absent(get):
    w = F.split("input", " ")
    tags = F.when(F.array_contains(w, C("edited_object")), w).otherwise(F.array_append(w, C("edited_object")))
    return get("instr").where("input is not null and edited_object is not null").select("row_id", F.array_join(tags, " ").alias("tags"))


@query("SELECT vec_id, CAST(round(list_sum(list_transform(range(0, 63, 3), lambda i: embedding[CAST(i + 1 AS INT)])) * 1000) AS BIGINT) AS thirds FROM embeddings")
def f33_strided_slice(get):
    third = F.filter("embedding", lambda x, i: (i % 3 == 0) & (i < 63))
    return get("embeddings").select("vec_id", F.round(F.aggregate(third, F.lit(0.0), lambda s, x: s + x) * 1000).cast("long").alias("thirds"))


@query("""SELECT row_id, array_to_string(list_filter(range(len(a)), lambda i: a[CAST(i + 1 AS INT)] <> b[CAST(i + 1 AS INT)]), ',') AS positions FROM (SELECT row_id, string_split(input, ' ') AS a, string_split(replace(input, 'near', 'by'), ' ') AS b FROM {instr})""")
def f20_word_differences(get):
    d = align.word_differences(C("input"), F.replace("input", F.lit("near"), F.lit("by")))
    return get("instr").select("row_id", F.array_join(d.cast("array<string>"), ",").alias("positions"))


@query()
def f19_alignment(get):
    return get.spread("instr").where("input is not null and output is not null").select("row_id", align.aligned(C("input"), C("output")).alias("partners"))


@query("""SELECT p_partkey, array_to_string(CASE WHEN n <= 1 THEN list_transform(range(8), lambda i: -1) WHEN n < 8 THEN list_concat(list_transform(range(8 - n), lambda i: -1), range(n))
    ELSE list_transform(range(8), lambda i: CAST(floor(i * (n - 2) / 7) AS BIGINT)) END, ',') AS frames FROM (SELECT p_partkey, p_size AS n FROM part)""")
def s28_frame_positions(get):
    return get("part").select("p_partkey", F.array_join(frame_positions(C("p_size"), 8).cast("array<string>"), ",").alias("frames"))


# --------------------------------------------------------------------------- guards with scores


@query("SELECT row_id, contains(lower(vqa_answer), 'y') AS kept FROM {scores}")
def f18_judge_keep(get):
    return get("scores").select("row_id", F.contains(F.lower("vqa_answer"), F.lit("y")).alias("kept"))


@query("SELECT row_id, CASE WHEN list_contains(string_split(input, ' '), string_split(edited_object, ' ')[-1]) THEN 'tried' ELSE 'failure' END AS colour, coalesce(contains(input, edited_object), false) AS attribute, coalesce(edited_object NOT IN ('people', 'man', 'woman', 'boy', 'girl', 'person', 'adult', 'child', 'hand', 'foot'), false) AS relation FROM {instr}")
def f24_f25_f27_driver_guards(get):
    obj = C("edited_object")
    return get("instr").select("row_id", F.when(t.has_word(C("input"), t.last_word(obj)), "tried").otherwise("failure").alias("colour"), r.passes(F.contains("input", obj)).alias("attribute"), r.passes(~obj.isin(r.PEOPLE_RELATED)).alias("relation"))


@query("SELECT row_id, CASE WHEN clip >= l1 THEN 1 ELSE 2 END AS candidate, greatest(clip, l1) > 0.15 AND NOT detected AS kept FROM {scores}")
def f31_better_candidate(get):
    return get("scores").select("row_id", F.when(C("clip") >= C("l1"), 1).otherwise(2).alias("candidate"), ((F.greatest("clip", "l1") > 0.15) & ~C("detected")).alias("kept"))


@query("SELECT row_id, edit_type, CASE edit_type WHEN 'add' THEN l1 < 0.5 WHEN 'remove' THEN l1 < 0.2 WHEN 'background_change' THEN l1 >= 0.05 ELSE true END AS kept FROM {instr} JOIN {scores} USING (row_id)")
def f40_f41_residuals(get):
    left = C("l1")
    rule = r.by_type({"add": left < 0.5, "remove": left < 0.2, "background_change": left >= 0.05}, F.lit(True))
    return get("instr").join(get("scores"), "row_id").select("row_id", "edit_type", rule.alias("kept"))


@query("SELECT image_id, min(box_id) AS box_id FROM (SELECT *, (x1 - x0) / 512 * ((y1 - y0) / 512) AS share FROM {boxes}) WHERE share > 0.1 AND share < 0.5 GROUP BY 1")
def f44_outpaint_box(get):
    rows = get("boxes").withColumn("share", bx.share_of_frame(bx.box(C("x0"), C("y0"), C("x1"), C("y1"))))
    return rows.where("share > 0.1 AND share < 0.5").groupBy("image_id").agg(F.min("box_id").alias("box_id"))


@query("SELECT image_id, count(*) AS small FROM {boxes} WHERE (x1 - x0) / 512 * ((y1 - y0) / 512) < 0.1 GROUP BY 1 HAVING count(*) >= 2")
def f46_small_objects(get):
    share = bx.share_of_frame(bx.box(C("x0"), C("y0"), C("x1"), C("y1")))
    return get("boxes").where(share < 0.1).groupBy("image_id").agg(F.count("*").alias("small")).where("small >= 2")


@query("SELECT row_id, greatest(clip, l1, clip_dir) > 0.35 AS detected, clip > 0.88 AND l1 >= 0.95 AS good FROM {scores}")
def f47_f49_thresholds(get):
    return get("scores").select("row_id", (F.array_max(F.array("clip", "l1", "clip_dir")) > 0.35).alias("detected"), ((C("clip") > 0.88) & (C("l1") >= 0.95)).alias("good"))


@query("SELECT box_id FROM {boxes} WHERE NOT ((abs(x0 - 100) <= 20 AND abs(x0 - 0) > 20) OR (abs(y0 - 50) <= 20 AND abs(y0 - 0) > 20) OR (abs(x1 - 400) <= 20 AND abs(x1 - 512) > 20) OR (abs(y1 - 300) <= 20 AND abs(y1 - 512) > 20))")
def f50_away_from_crop_edge(get):
    b = bx.box(C("x0"), C("y0"), C("x1"), C("y1"))
    crop, image = ({k: F.lit(v) for k, v in zip(("x0", "y0", "x1", "y1"), x, strict=True)} for x in ((100.0, 50.0, 400.0, 300.0), (0.0, 0.0, 512.0, 512.0)))
    return get("boxes").where(~bx.near_crop_edge(b, crop, image)).select("box_id")


# --------------------------------------------------------------------------- geometry decisions


@query("SELECT row_id, CASE WHEN l1 < 0.33 THEN 8 WHEN l1 < 0.66 THEN 15 ELSE 20 END AS kernel FROM {scores}")
def g21_kernels(get):
    return get("scores").select("row_id", F.when(C("l1") < 0.33, 8).when(C("l1") < 0.66, 15).otherwise(20).alias("kernel"))


@query("SELECT user_id, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a24_mean(get):
    return get("events").groupBy("user_id").agg(F.max("value").alias("most"), R(F.avg("value")).alias("mean"))


@query("""SELECT vec_id, round(len(list_filter(embedding, lambda x: x > 0.05::FLOAT)) / nullif(len(list_filter(embedding, lambda x: x > -0.05::FLOAT)), 0), 6) AS stability,
    len(list_filter(embedding, lambda x: x > 0::FLOAT))::BIGINT AS area FROM embeddings""")
def g11_stability(get):
    """Of masks as logits, an array of them each: how much the area shrinks from a lower to a higher threshold."""
    x = C("embedding")
    return get("embeddings").select("vec_id", R(v.stability(x, F.lit(0.0).cast("float"), F.lit(0.05).cast("float"))).alias("stability"), F.size(F.filter(x, lambda e: e > 0)).cast("long").alias("area"))


@query("SELECT box_id, round(x0 + 64, 6) AS x0, round(y0 + 32, 6) AS y0, round(x0 * 0.5, 6) AS sx, round(y1 * 2, 6) AS sy FROM {boxes}")
def g14_g17_moved_and_scaled(get):
    b = bx.box(C("x0"), C("y0"), C("x1"), C("y1"))
    m, s = bx.shifted(b, F.lit(64.0), F.lit(32.0)), bx.scaled(b, F.lit(0.5), F.lit(2.0))
    return get("boxes").select("box_id", R(m["x0"]).alias("x0"), R(m["y0"]).alias("y0"), R(s["x0"]).alias("sx"), R(s["y1"]).alias("sy"))


@query("""WITH i AS (SELECT unnest(range(6)) AS y), k AS (SELECT unnest(range(5)) AS x), p AS (SELECT p_partkey AS p, 3 + p_size % 7 AS h, 2 + p_partkey % 6 AS w FROM part),
    s AS (SELECT p, y, x, h, w, least(greatest((y + 0.5::DOUBLE) * h / 6 - 0.5, 0), h - 1) AS sy, least(greatest((x + 0.5::DOUBLE) * w / 5 - 0.5, 0), w - 1) AS sx FROM p, i, k),
    f AS (SELECT p, y, x, least(floor(sy), h - 2)::BIGINT AS y0, least(floor(sx), w - 2)::BIGINT AS x0, sy - least(floor(sy), h - 2) AS fy, sx - least(floor(sx), w - 2) AS fx FROM s),
    v AS (SELECT p, ((p * 7 + y * 13 + x * 29) % 256)::DOUBLE AS a, (1 - fy) * (1 - fx) * ((p * 5 + y0 * 17 + x0 * 31) % 256) + (1 - fy) * fx * ((p * 5 + y0 * 17 + (x0 + 1) * 31) % 256) + fy * (1 - fx) * ((p * 5 + (y0 + 1) * 17 + x0 * 31) % 256)
        + fy * fx * ((p * 5 + (y0 + 1) * 17 + (x0 + 1) * 31) % 256) AS b FROM f)
    SELECT p AS p_partkey, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS similarity FROM v GROUP BY 1""")
def f42_picture_similarity(get):
    """Cosine of two pictures, the second brought to the size of the first."""
    def picture(h, w, a, b, c):
        i = F.sequence(F.lit(0).cast("long"), (h * w - 1).cast("long"))
        return F.transform(i, lambda k: ((C("p_partkey") * a + F.floor(k / w) * b + k % w * c) % 256).cast("double"))

    h, w = (C("p_size") % 7 + 3).cast("int"), (C("p_partkey") % 6 + 2).cast("int")
    rows = get("part").select("p_partkey", picture(F.lit(6), F.lit(5), 7, 13, 29).alias("a"), raster.resized(picture(h, w, 5, 17, 31), h, w, F.lit(6), F.lit(5)).alias("b"))
    return rows.select("p_partkey", R(v.cosine(C("a"), C("b"))).alias("similarity"))


@query("SELECT row_id, round(('0x' || substr(md5('clip|' || row_id), 1, 8))::BIGINT / 4294967296.0, 9) AS clip, size * 2.0 + price AS model FROM {instr}")
def m01_scorers(get):
    """A stand-in and a model loaded once a worker."""

    def load():
        return lambda x: pd.Series(x["size"] * 2.0 + x["price"])

    rows = scorers.scored(get("instr").select("row_id", "size", "price"), [scorers.stand_in("clip", "row_id"), scorers.from_model("model", load, ["size", "price"])])
    return rows.select("row_id", R("clip", 9).alias("clip"), "model")


# --------------------------------------------------------------------------- further functions, joins and sinks


@query("SELECT p_partkey, lower(p_brand) AS low, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS titled, replace(p_name, 'a', 'o') AS swapped, contains(p_name, 'ol') AS inside, list_contains(string_split(p_name, ' '), 'old') AS word FROM part")
def f05_f08_string_basics(get):
    return get("part").select("p_partkey", F.lower("p_brand").alias("low"), F.initcap("p_name").alias("titled"), F.replace("p_name", F.lit("a"), F.lit("o")).alias("swapped"), F.contains("p_name", F.lit("ol")).alias("inside"), t.has_word(C("p_name"), F.lit("old")).alias("word"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderkey) AS names FROM orders GROUP BY 1")
def f11_joined_names(get):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return get("orders").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda s: s["o_orderpriority"]), ", ").alias("names"))


@query("SELECT row_id, len(regexp_extract_all(input, '[a-z]+')) AS words, regexp_extract_all(input, '[a-z]+')[2] AS second FROM {instr} WHERE input IS NOT NULL")
def f12_found_words(get):
    w = F.regexp_extract_all("input", F.lit("[a-z]+"), F.lit(0))
    return get("instr").where("input is not null").select("row_id", F.size(w).alias("words"), w[1].alias("second"))


@query("SELECT c_custkey, md5(c_name || '|' || c_mktsegment) AS signed FROM customer")
def f16_signed(get):
    return get("customer").select("c_custkey", F.md5(F.concat_ws("|", "c_name", "c_mktsegment")).alias("signed"))


@query("SELECT p_partkey, regexp_extract('[INST] q [/INST] ' || p_name || '</s>', '\\[/INST\\] (.*?)</s>', 1) AS answer FROM part")
def f18_between_tags(get):
    s = F.concat(F.lit("[INST] q [/INST] "), "p_name", F.lit("</s>"))
    return get("part").select("p_partkey", F.regexp_extract(s, r"(?s)\[/INST\] (.*?)</s>", 1).alias("answer"))


@query("SELECT row_id, array_to_string(list_filter(string_split(input, ' '), lambda x: NOT list_contains(string_split(output, ' '), x)), ' ') AS only FROM {instr} WHERE input IS NOT NULL AND output IS NOT NULL")
def f31_list_difference(get):
    only = F.filter(F.split("input", " "), lambda x: ~F.array_contains(F.split("output", " "), x))
    return get.spread("instr").where("input is not null and output is not null").select("row_id", F.array_join(only, " ").alias("only"))


@query("SELECT row_id, trunc(clip * 512 - l1 * 512)::INT AS x, least(greatest(trunc(l1 * 600), 0), 512)::INT AS y, round((1 + 4) * clip * l1 / nullif(4 * clip + l1, 0), 6) AS f2 FROM {scores}")
def f53_f54_scaled(get):
    from curatrix.functions.vector import f_score

    x, y = (C("clip") * 512 - C("l1") * 512).cast("int"), F.least(F.greatest((C("l1") * 600).cast("int"), F.lit(0)), F.lit(512))
    return get("scores").select("row_id", x.alias("x"), y.alias("y"), R(f_score(C("clip"), C("l1"), 2.0)).alias("f2"))


@query("SELECT o_custkey, '[' || string_agg('{\"k\":' || o_orderkey || '}', ',' ORDER BY o_orderkey) || ']' AS j FROM orders GROUP BY 1")
def k01_json_arrays(get):
    """A JSON array a customer: one array of a whole table would be one row of one task."""
    return get("orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(C("o_orderkey").alias("k"))))).alias("j"))


@query("SELECT row_id, n_name AS reference FROM {instr} JOIN nation ON n_nationkey = ('0x' || substr(md5('ref|' || row_id), 1, 8))::BIGINT % 25")
def j09_drawn_reference(get):
    from curatrix.functions.sampling import draw

    rows = get("instr").select("row_id", (draw(C("row_id"), "ref") % 25).alias("key"))
    return rows.join(get("nation"), C("key") == C("n_nationkey")).select("row_id", C("n_name").alias("reference"))


@query("SELECT l_orderkey AS image_id, p_partkey AS point_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def j10_observations(get):
    """Images joined to the points that they see."""
    seen = get("lineitem").select(C("l_orderkey").alias("image_id"), C("l_partkey").alias("point_id"))
    points = get("part").select(C("p_partkey").alias("point_id"))
    return seen.join(points, "point_id").groupBy("image_id", "point_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def j13_joined_on_row_id(get):
    """Records meet their answers by id, so rows without an answer shift nothing."""
    return get("documents").select("doc_id", "lang").join(get("labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def j15_label_lookup(get):
    return get("documents").select("doc_id").join(get("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents), l AS (SELECT word, regexp_replace(word, '(ing|ed|s)$', '') AS lemma FROM w WHERE ('0x' || substr(md5(word), 1, 8))::BIGINT % 3 = 0)
    SELECT conv_id, turn, coalesce(lemma, string_split(text, ' ')[1]) AS lemma FROM conversations LEFT JOIN l ON word = string_split(text, ' ')[1]""")
def f51_lemma_lookup(get):
    """First words by a lexicon, a table of the words of documents; words that it lacks stay."""
    word = get("documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    lexicon = word.where(draw_of("word") % 3 == 0).withColumn("lemma", F.regexp_replace("word", "(ing|ed|s)$", ""))
    rows = get("conversations").select("conv_id", "turn", t.first_word(C("text")).alias("word"))
    return rows.join(lexicon, "word", "left").select("conv_id", "turn", F.coalesce("lemma", "word").alias("lemma"))


@query("SELECT event_type, count(DISTINCT user_id) AS seen, quantile_disc(value, 0.5) AS middle FROM events GROUP BY 1")
def extension_percentile(get):
    return get("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("seen"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("middle"))


@query("SELECT o_custkey, arg_max(o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) * 1000000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def o05_numeric_prefix_order(get):
    rank = F.struct(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).cast("int").alias("p"), "o_orderkey")
    return get("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", rank).alias("o_orderkey"))
