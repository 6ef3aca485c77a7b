"""Queries over boxes, masks and pixels: suppression, components, run lengths, whole-pixel geometry, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import boxes as bx
from curatrix.functions import runs
from curatrix.functions import vector as v
from curatrix.operators import vision
from curatrix.plans.base import query

C = F.col
R = lambda c, n=6: F.round(c, n)
counts = lambda: F.array("c0", "c1", "c2", "c3", "c4")
masks = lambda get: get("masks").select("id", "h", counts().alias("counts"))
box = lambda: bx.box(C("x0"), C("y0"), C("x1"), C("y1"))

_ON = "list_concat(range(c0, c0 + c1), range(c0 + c1 + c2, c0 + c1 + c2 + c3))"


def _components(on: bool = True) -> str:
    """comp (id, component, area) of the pixels that are on or off."""
    pixels = _ON if on else f"list_filter(range(64), lambda i: NOT list_contains({_ON}, i))"
    return f"""px AS (SELECT id, unnest({pixels}) AS p FROM {{masks}}),
    adj AS (SELECT a.id, a.p AS p, b.p AS q FROM px a JOIN px b ON a.id = b.id AND abs(a.p // 8 - b.p // 8) <= 1 AND abs(a.p % 8 - b.p % 8) <= 1),
    reach AS (SELECT id, p, p AS q FROM px UNION SELECT r.id, r.p, a.q FROM reach r JOIN adj a ON r.id = a.id AND r.q = a.p),
    comp AS (SELECT id, component, count(*) AS area FROM (SELECT id, p, min(q) AS component FROM reach GROUP BY 1, 2) GROUP BY 1, 2)"""


# --------------------------------------------------------------------------- boxes


_BOXES = "(SELECT image_id, box_id, min({'score': score, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) AS b FROM {boxes} GROUP BY 1, 2)"
_IOU = """greatest(0, least(k.x1, x[1].x1) - greatest(k.x0, x[1].x0)) * greatest(0, least(k.y1, x[1].y1) - greatest(k.y0, x[1].y0))"""


def _one_each(get):
    rows = get("boxes").groupBy("image_id", "box_id").agg(F.min(F.struct("score", "x0", "y0", "x1", "y1")).alias("b"))
    return rows.select("image_id", "box_id", "b.*")


@query(f"""WITH l AS (SELECT image_id, list([{{'box_id': box_id, 'score': b.score, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}] ORDER BY b.score DESC, box_id) AS l FROM {_BOXES} GROUP BY 1),
    k AS (SELECT image_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_IOU} > 0.5 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (x[1].x1 - x[1].x0) * (x[1].y1 - x[1].y0) - {_IOU}))) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM l)
    SELECT image_id, k.box_id, k.score FROM k""")
def g06_suppressed(get):
    return vision.suppressed(_one_each(get), "image_id", 0.5).select("image_id", "box_id", "score")


@query()
def g06_softly_suppressed(get):
    """Tested against brute force: each step depends on the scores that the one before left."""
    return vision.softly_suppressed(_one_each(get), "image_id").select("image_id", "box_id", R("score").alias("score"))


@query("""SELECT image_id, box_id FROM (SELECT image_id, box_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY image_id) AS n FROM (SELECT image_id, box_id, b.score AS score FROM """ + _BOXES + """) WINDOW w AS (PARTITION BY image_id ORDER BY score DESC, box_id))
    WHERE k <= 1 + image_id % 3 AND n >= 1 + image_id % 3 AND n > 1""")
def o12_enough_masks(get):
    rows = vision.enough_per_group(_one_each(get).withColumn("o", F.struct((-C("score")).alias("s"), "box_id")), "image_id", C("o").asc(), C("image_id") % 3 + 1)
    return rows.select("image_id", "box_id")


@query("""WITH b AS (SELECT image_id, box_id, floor(x0)::BIGINT AS x0, floor(y0)::BIGINT AS y0, floor(x1)::BIGINT AS x1, floor(y1)::BIGINT AS y1 FROM {boxes})
    SELECT box_id, greatest(0, trunc((x0 + x1) * 0.5 - 1.5 * (x1 - x0 + 1) * 0.5))::BIGINT AS ex0, least(512, trunc((y0 + y1) * 0.5 + 1.5 * (y1 - y0 + 1) * 0.5))::BIGINT AS ey1,
        greatest(0, CASE WHEN y1 - y0 >= x1 - x0 THEN (x0 + x1) // 2 - (y1 - y0) // 2 ELSE x0 END)::BIGINT AS sx0, least(512, CASE WHEN y1 - y0 >= x1 - x0 THEN y1 ELSE (y0 + y1) // 2 + (x1 - x0) // 2 END)::BIGINT AS sy1,
        least(trunc(x1 / 512.0::DOUBLE * 300), 300)::BIGINT AS rx1, least(trunc(y0 / 512.0::DOUBLE * 200), 200)::BIGINT AS ry0, x0 - 100 AS dx0,
        CASE WHEN x1 - x0 < y1 - y0 THEN ((y1 - y0) - (x1 - x0)) // 2 ELSE 0 END AS pad_left, CASE WHEN x1 - x0 > y1 - y0 THEN (x1 - x0) - (y1 - y0) - ((x1 - x0) - (y1 - y0)) // 2 ELSE 0 END AS pad_bottom FROM b""")
def g17_whole_pixel_boxes(get):
    """Boxes grown, squared, padded, moved into another frame and scaled to another size, in whole pixels."""
    whole = lambda c: F.floor(C(c)).alias(c)
    rows = get("boxes").select("box_id", *map(whole, ("x0", "y0", "x1", "y1")))
    side = F.lit(512).cast("long")
    e, s = bx.expanded(box(), F.lit(1.5), side, side), bx.squared(box(), side, side)
    z, d = bx.resized(box(), side, side, F.lit(300), F.lit(200)), bx.relative(box(), bx.box(*[F.lit(n).cast("long") for n in (100, 50, 300, 250)]))
    pad = bx.square_padding(C("x1") - C("x0"), C("y1") - C("y0"))
    return rows.select("box_id", e["x0"].alias("ex0"), e["y1"].alias("ey1"), s["x0"].alias("sx0"), s["y1"].alias("sy1"), z["x1"].alias("rx1"), z["y0"].alias("ry0"), d["x0"].alias("dx0"), pad["left"].alias("pad_left"), pad["bottom"].alias("pad_bottom"))


@query("""SELECT box_id, CASE WHEN x0 + floor((x1 - x0) * 1.3) > 512 OR y0 + floor((y1 - y0) * 1.3) > 512 THEN 0.7 ELSE 1.3 END::DOUBLE AS fitting,
    CASE WHEN floor((512 - x0) / (x1 - x0)) < 1.5 OR floor((512 - y0) / (y1 - y0)) < 1.5 THEN 0.7 ELSE 1.3 END::DOUBLE AS headroom FROM {boxes}""")
def g19_scales(get):
    side = F.lit(512.0)
    return get("boxes").select("box_id", bx.fitting_scale(box(), F.lit(1.3), side, side).alias("fitting"), bx.headroom_scale(box(), side, side).alias("headroom"))


# --------------------------------------------------------------------------- masks


@query(f"WITH RECURSIVE {_components()} SELECT id, component, area FROM comp")
def a23_components(get):
    return vision.components(masks(get))


@query(f"""WITH RECURSIVE {_components()} SELECT id, round(max(area) FILTER (area >= 3) / sum(area) FILTER (area >= 3), 6) AS largest,
    coalesce(max(area) FILTER (area >= 3) / sum(area) FILTER (area >= 3) < 1 - 0.15, false) AS occluded FROM comp GROUP BY 1""")
def f42_occlusion(get):
    return vision.occlusion(vision.components(masks(get)), 0.15, 3).withColumn("largest", R("largest"))


@query(f"WITH RECURSIVE {_components()} SELECT id, CASE WHEN sum(area) < 10 THEN 0 ELSE round(max(area) / sum(area), 6) END::DOUBLE AS score FROM comp GROUP BY 1")
def g16_connectivity(get):
    return vision.connectivity(vision.components(masks(get))).withColumn("score", R("score"))


@query(f"""WITH RECURSIVE {_components()} SELECT m.id, coalesce(sum(area) FILTER (area >= 5), max(area), 0)::BIGINT AS area, coalesce(min(area) < 5, false) AS changed FROM {{masks}} m LEFT JOIN comp USING (id) GROUP BY 1""")
def g15_islands_removed(get):
    return vision.without_small(masks(get), 5).select("id", bx.rle_area(C("counts")).alias("area"), "changed")


@query(f"""WITH RECURSIVE {_components(False)} SELECT m.id, (any_value(c1 + c3) + coalesce(sum(area) FILTER (area < 12), 0))::BIGINT AS area, coalesce(min(area) < 12, false) AS changed FROM {{masks}} m LEFT JOIN comp USING (id) GROUP BY 1""")
def g15_holes_filled(get):
    return vision.without_small(masks(get), 12, holes=True).select("id", bx.rle_area(C("counts")).alias("area"), "changed")


_GRID = "(SELECT unnest(range(64)) AS p)"


def _as_runs(pixels: str, key: str = "id", size: str = "64") -> str:
    """(key, runs) of `pixels` (key, i) for each key of the masks: a mask of `size` pixels as text."""
    return f"""px AS ({pixels}), b AS (SELECT {key}, i, has IS NOT NULL AS b FROM (SELECT DISTINCT {key} FROM m) CROSS JOIN (SELECT unnest(range({size})) AS i) LEFT JOIN (SELECT DISTINCT {key}, i, 1 AS has FROM px) px USING ({key}, i)),
    r AS (SELECT {key}, i, b, coalesce(b <> lag(b) OVER (PARTITION BY {key} ORDER BY i), true) AS new FROM b), g AS (SELECT {key}, b, sum(new::INT) OVER (PARTITION BY {key} ORDER BY i) AS run FROM r),
    n AS (SELECT {key}, run, any_value(b) AS b, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT {key}, CASE WHEN bool_or(b AND run = 1) THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY run) AS runs FROM n GROUP BY 1"""


_M = f"m AS (SELECT id, {_ON} AS a FROM {{masks}})"
_TWO = f"m AS (SELECT l.id, l.a AS a, r.a AS o FROM (SELECT id, {_ON} AS a FROM {{masks}}) l JOIN (SELECT id - 1 AS id, {_ON} AS a FROM {{masks}}) r USING (id))"
said = lambda c: F.array_join(c.cast("array<string>"), ",").alias("runs")
side = lambda n=8: F.lit(n)


def _neighbours(get):
    """Each mask with that of the next id."""
    rows = get("masks").select("id", counts().alias("a"))
    return rows.join(get("masks").select((C("id") - 1).alias("id"), counts().alias("b")), "id")


@query(f"WITH m AS (SELECT id // 4 AS object, {_ON} AS a FROM {{masks}}), {_as_runs('SELECT object, unnest(a) AS i FROM m', 'object')}")
def g10_merged_masks(get):
    """The masks of one object as one: any pixel that one of them has."""
    rows = get("masks").select(F.floor(C("id") / 4).alias("object"), counts().alias("counts"))
    return vision.merged_masks(rows, "object").select("object", said(C("counts")))


@query(f"WITH {_TWO}, {_as_runs('SELECT id, unnest(list_distinct(list_concat(a, o))) AS i FROM m')}")
def g10_united(get):
    return _neighbours(get).select("id", said(runs.union(C("a"), C("b"))))


@query(f"WITH {_TWO}, {_as_runs('SELECT id, unnest(list_filter(a, lambda x: list_contains(o, x))) AS i FROM m')}")
def g09_intersected(get):
    return _neighbours(get).select("id", said(runs.intersection(C("a"), C("b"))))


@query(f"WITH {_TWO}, {_as_runs('SELECT id, unnest(list_filter(a, lambda x: NOT list_contains(o, x))) AS i FROM m')}")
def g10_subtracted(get):
    return _neighbours(get).select("id", said(runs.difference(C("a"), C("b"))))


@query(f"WITH {_M}, {_as_runs('SELECT id, unnest(a) AS i FROM m')}")
def g07_rle_encoded(get):
    """Runs of the pixels of a mask, made anew: without the empty runs that the mask's own may hold."""
    return get("masks").select("id", said(runs.encoded(runs.decoded(counts()))))


@query(f"WITH {_M}, {_as_runs('SELECT id, (p // 8 - 2) * 5 + p % 8 - 1 AS i FROM (SELECT id, unnest(a) AS p FROM m) WHERE p // 8 BETWEEN 2 AND 6 AND p % 8 BETWEEN 1 AND 5', size='25')}")
def g24_cropped_masks(get):
    """The part of each mask in a box, of the box's size."""
    return get("masks").select("id", said(runs.crop(counts(), side(), F.lit(2), F.lit(1), F.lit(7), F.lit(6))))


@query(f"WITH {_M}, {_as_runs('SELECT id, (p // 8 + 3) * 10 + p % 8 - 2 AS i FROM (SELECT id, unnest(a) AS p FROM m) WHERE p // 8 + 3 < 9 AND p % 8 >= 2', size='90')}")
def g24_pasted_masks(get):
    """Each mask in a larger image, three columns to the right and two rows up; what leaves the image is lost."""
    return get("masks").select("id", said(runs.paste(counts(), side(), side(10), side(9), F.lit(3), F.lit(-2))))


_NEAR = "abs(a.p // 8 - b.p // 8) <= 1 AND abs(a.p % 8 - b.p % 8) <= 1"
_CROSS = "abs(a.p // 8 - b.p // 8) + abs(a.p % 8 - b.p % 8) <= 1"
_P = "p AS (SELECT id, unnest(a) AS p FROM m)"


@query(f"WITH {_M}, {_P}, {_as_runs(f'SELECT DISTINCT id, b.p AS i FROM p a JOIN {_GRID} b ON {_NEAR}')}")
def g25_dilated(get):
    return get("masks").select("id", said(runs.dilation(counts(), side(), side(), F.lit(1))))


@query(f"WITH {_M}, {_P}, {_as_runs(f'SELECT DISTINCT id, b.p AS i FROM p a JOIN {_GRID} b ON {_CROSS}')}")
def g25_dilated_by_a_cross(get):
    return get("masks").select("id", said(runs.dilation(counts(), side(), side(), F.lit(1), cross=True)))


@query(f"WITH {_M}, {_P}, q AS (SELECT id, b.p FROM m, {_GRID} b WHERE NOT list_contains(a, b.p)), {_as_runs(f'SELECT id, p AS i FROM p EXCEPT SELECT DISTINCT id, b.p AS i FROM q a JOIN {_GRID} b ON {_NEAR}')}")
def g25_eroded(get):
    return get("masks").select("id", said(runs.erosion(counts(), side(), side(), F.lit(1))))


@query(f"WITH {_M}, {_P}, q AS (SELECT id, b.p FROM m, {_GRID} b WHERE NOT list_contains(a, b.p)), {_as_runs(f'SELECT DISTINCT id, a.p AS i FROM p a JOIN q b USING (id) WHERE {_NEAR}')}")
def g25_edges(get):
    """What an erosion takes from a mask: its inner border."""
    return get("masks").select("id", said(runs.difference(counts(), runs.erosion(counts(), side(), side(), F.lit(1)))))


# --------------------------------------------------------------------------- numbers


@query("SELECT label, pos - 1 AS pos, max(e)::DOUBLE AS most FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def a22_elementwise_max(get):
    """The greatest value at each position of the rows of a group."""
    rows = get("embeddings").select("label", F.posexplode("embedding").alias("pos", "e"))
    return rows.groupBy("label", "pos").agg(F.max(C("e").cast("double")).alias("most"))


@query("""WITH q AS (SELECT row_id, clip / n AS w, l1 / n AS x, clip_dir / n AS y, -0.5 / n AS z FROM (SELECT *, sqrt(clip * clip + l1 * l1 + clip_dir * clip_dir + 0.25) AS n FROM {scores}))
    SELECT row_id, round(-w, 6) + 0.0 AS w, round(-x, 6) + 0.0 AS x, round(-y, 6) + 0.0 AS y, round(-z, 6) + 0.0 AS z FROM q""")
def f51_quaternions(get):
    """Quaternions back from the matrices made of them; of the two of a matrix that whose z, never 0 here, is positive."""
    q = v.unit(F.array(C("clip"), C("l1"), C("clip_dir"), F.lit(-0.5)))
    rows = get.spread("scores").select("row_id", v.rotation(q).alias("m")).select("row_id", v.quaternion(C("m")).alias("q"))
    return rows.select("row_id", *[(R(C("q")[i] * F.signum(C("q")[3])) + 0.0).alias(c) for i, c in enumerate("wxyz")])


@query("""WITH g AS (SELECT u, exp(-((u - 5) ** 2) / 4.5) AS w FROM (SELECT unnest(range(11)) AS u)), k AS (SELECT a.u AS u, b.u AS t, a.w * b.w / (SELECT sum(w) ** 2 FROM g) AS w FROM g a, g b),
    s AS (SELECT p_partkey, y, x, w, ((p_partkey * 7 + (y + u) * 13 + (x + t) * 29) % 256)::DOUBLE AS a, ((p_partkey * 7 + (y + u) * 13 + (x + t) * 29 + p_size * (y + u) % 17) % 256)::DOUBLE AS b
        FROM part, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x), k),
    m AS (SELECT p_partkey, y, x, sum(w * a) AS ma, sum(w * b) AS mb, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM s GROUP BY 1, 2, 3)
    SELECT p_partkey, round(avg((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))), 5) AS ssim FROM m GROUP BY 1""")
def f47_ssim(get):
    i = F.sequence(F.lit(0).cast("long"), F.lit(195).cast("long"))
    at = lambda i: C("p_partkey") * 7 + F.floor(i / 14) * 13 + i % 14 * 29
    rows = get.spread("part").select("p_partkey", F.transform(i, lambda i: (at(i) % 256).cast("int")).alias("a"), F.transform(i, lambda i: ((at(i) + C("p_size") * F.floor(i / 14) % 17) % 256).cast("int")).alias("b"))
    return rows.select("p_partkey", R(v.ssim(C("a"), C("b"), 14), 5).alias("ssim"))
