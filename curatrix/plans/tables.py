"""Queries of joins, groupings, windows, sorts, sets, vectors, boxes and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.functions import boxes as bx
from curatrix.functions import sampling as sm
from curatrix.functions import vector as v
from curatrix.operators import relational as rel
from curatrix.operators import keywords, similarity, vision
from curatrix.plans.base import query
from curatrix.sources.shared import shared_path
from curatrix.streaming import meters

C = F.col
R = lambda c, n=6: F.round(c, n)

# --------------------------------------------------------------------------- joins


@query("""WITH src AS (SELECT image_file AS k, max_by(input, row_id) AS i, max_by(output, row_id) AS o FROM (SELECT concat(split_part(image_file, '/', 2), '/', size) AS image_file, coalesce(input, '') AS input, coalesce(output, '') AS output, row_id FROM {instr}) GROUP BY 1)
    SELECT row_id, coalesce(input, i) AS input, coalesce(output, o) AS output FROM {instr} LEFT JOIN src ON k = concat(split_part(image_file, '/', 2), '/', size)""")
def j01_j02_back_filled(get):
    rows = get("instr").withColumn("key", F.concat(F.split_part("image_file", F.lit("/"), F.lit(2)), F.lit("/"), C("size").cast("string")))
    sources = rows.select("key", C("row_id").alias("position"), F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"))
    return rel.back_filled(rows.select("row_id", "key", "input", "output"), sources, "key", ["input", "output"], "position").drop("key")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j14_unfinished(get):
    done = get("customer").where("c_mktsegment = 'MACHINERY'").select(C("c_custkey").alias("o_custkey"))
    return rel.unfinished(get("orders").select("o_orderkey", "o_custkey"), done, "o_custkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size > 40)")
def j05_membership(get):
    known = get("part").where("p_type = 'PROMO' AND p_size > 40").select(C("p_partkey").alias("l_partkey"))
    return get("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


def _said(get, key: str, order: str, value: str, table: str, to: str):
    """(k, to): the values of each key in order. Keys are persons, so lists stay short."""
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return get(table).groupBy(C(key).cast("long").alias("k")).agg(F.transform(rows, lambda s: s[value]).alias(to))


_PRIORITIES = "SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey, o_orderpriority) AS x FROM orders GROUP BY 1"
_TURNS = "SELECT conv_id AS k, list(role ORDER BY turn, role) AS y FROM conversations GROUP BY 1"


@query(f"SELECT k, array_to_string(list_concat(x, y), '|') AS names FROM ({_PRIORITIES}) JOIN ({_TURNS}) USING (k)")
def j03_joined_lists(get):
    both = _said(get, "o_custkey", "o_orderkey", "o_orderpriority", "orders", "x").join(_said(get, "conv_id", "turn", "role", "conversations", "y"), "k")
    return both.select("k", F.array_join(F.concat("x", "y"), "|").alias("names"))


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey GROUP BY n_name")
def j04_left_with_empty(get):
    s = get("supplier").where("s_acctbal > 9000").groupBy(C("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return get("nation").join(s, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("suppliers"))


@query("WITH p AS (SELECT p_name AS v, min(p_partkey) AS pos FROM part GROUP BY 1) SELECT a.v AS first, b.v AS second FROM p a JOIN p b ON a.pos < b.pos")
def j07_value_pairs(get):
    return rel.value_pairs(get("part").select("p_name", "p_partkey"), "p_name", "p_partkey")


_V = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"


@query(f"WITH q AS (SELECT * FROM ({_V}) WHERE vec_id % 100 = 0) SELECT q.vec_id AS probe, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM q JOIN ({_V}) v ON q.vec_id <> v.vec_id AND list_cosine_similarity(q.e, v.e) > 0.3")
def j08_probes_over_threshold(get):
    """A stated set of probes, every hundredth vector, against all vectors, in whatever partitions these are read."""
    x = get("embeddings").select("vec_id", "embedding")
    both = similarity.over_threshold(x.where("vec_id % 100 = 0"), x, 0.3)
    return both.withColumn("similarity", R("similarity"))


_SIMILAR_EDGES = [-1.0, 0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


@query(f"""WITH v AS ({_V}), s AS (SELECT round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id),
    h AS (SELECT len(list_filter({_SIMILAR_EDGES}, lambda e: e <= s)) - 1 AS bin, 2 * count(*) AS n FROM s WHERE s >= -1 AND s < 1 GROUP BY 1)
    SELECT bin::INT AS bin, {_SIMILAR_EDGES}[bin + 1]::DOUBLE AS low, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(7)) AS bin) LEFT JOIN h USING (bin)""")
def j06_a06_similarity_histogram(get):
    """Similarities of all ordered pairs of vectors, counted by bins from an edge up to the next."""
    return similarity.pair_counts(get("embeddings"), _SIMILAR_EDGES, ordered=True)


@query("""SELECT a.image_id, a.box_id AS box_a, b.box_id AS box_b, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))
    / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) + 1e-6), 6) AS iou
    FROM {boxes} a JOIN {boxes} b ON a.image_id = b.image_id AND a.box_id < b.box_id""")
def j11_g02_pairwise_iou(get):
    pairs = rel.pairs_within(get("boxes"), "image_id", "box_id")
    return pairs.select("image_id", C("a.box_id").alias("box_a"), C("b.box_id").alias("box_b"), R(bx.iou(C("a"), C("b"), 1e-6)).alias("iou"))


@query("""SELECT box_id FROM {boxes} a WHERE phrase = 'dog' AND EXISTS (SELECT 1 FROM {boxes} b WHERE b.phrase = 'cat' AND a.image_id = b.image_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)""")
def j12_any_overlap(get):
    rows = get("boxes").withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    return vision.any_overlap(rows.where("phrase = 'dog'"), rows.where("phrase = 'cat'"), "image_id").select("box_id")


# --------------------------------------------------------------------------- groupings


@query("""WITH e AS (SELECT string_split(p_name, ' ')[-1] AS word, count(*) AS n FROM part WHERE contains(p_name, ' ') GROUP BY 1), o AS (SELECT DISTINCT p_name AS word FROM part)
    SELECT word, n + CASE WHEN o.word IS NULL THEN 0 ELSE 1 END AS n FROM e LEFT JOIN o USING (word)""")
def a01_word_groups(get):
    return rel.word_groups(get("part"), "p_name")


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS names FROM part GROUP BY 1 HAVING count(DISTINCT p_name) >= 5")
def a02_distinct_sets(get):
    return get("part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("s")).where(F.size("s") >= 5).select("p_brand", F.array_join("s", "|").alias("names"))


@query(f"SELECT k, array_to_string(list_concat(coalesce(x, []), coalesce(y, [])), '|') AS names FROM ({_PRIORITIES}) FULL JOIN ({_TURNS}) USING (k)")
def a04_merged_lists(get):
    lists = [_said(get, "o_custkey", "o_orderkey", "o_orderpriority", "orders", "names"), _said(get, "conv_id", "turn", "role", "conversations", "names")]
    return rel.merged_lists(lists, "k", "names").withColumn("names", F.array_join("names", "|"))


@query("""WITH k AS (SELECT lower(split_part(p_name, ' ', 2)) AS keyword, min(p_partkey) AS ord FROM part WHERE p_size > 30 GROUP BY 1)
    SELECT p_partkey, (SELECT upper(left(min_by(keyword, ord), 1)) || substr(min_by(keyword, ord), 2) FROM k WHERE concat(' ', lower(p_name), ' ') LIKE concat('% ', keyword, ' %')) AS keyword FROM part""")
def a05_keyword_roll_up(get):
    """Names by the first of the keywords that they have; the keywords are second words of other names."""
    rows = get("part").select("p_partkey", "p_name")
    keys = get("part").where("p_size > 30").groupBy(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("keyword")).agg(F.min("p_partkey").alias("ord"))
    return keywords.first_keyword(rows, "p_name", keys).select("p_partkey", "keyword")


@query(r"""WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), g AS (SELECT item_id * 1000 + i AS ord, w[i] || CASE WHEN i % 3 = 0 THEN '' ELSE ' ' || w[i + 1] END AS keyword FROM (SELECT *, unnest(range(1, least(len(w), 500))) AS i FROM w)),
    k AS (SELECT keyword, min(ord) AS ord FROM g GROUP BY 1), d AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    t AS (SELECT DISTINCT doc_id, unnest([w[i], w[i] || ' ' || w[i + 1]]) AS keyword FROM s) SELECT doc_id, ord FROM documents LEFT JOIN (SELECT doc_id, min(ord) AS ord FROM t JOIN k USING (keyword) GROUP BY 1) USING (doc_id)""")
def a05_first_keyword_of_documents(get):
    """Which of the words and pairs of words of the benchmark, in its order, is the first that a document has."""
    w = F.split(F.lower("text"), " ")
    some = get("benchmark").select("item_id", w.alias("w"), F.explode(F.sequence(F.lit(1), F.least(F.size(w), F.lit(500)) - 1)).alias("i")).where("size(w) > 1")
    pair = F.concat(F.get("w", C("i") - 1), F.when(C("i") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.get("w", C("i")))))
    keys = some.groupBy(pair.alias("keyword")).agg(F.min(C("item_id") * 1000 + C("i")).alias("ord"))
    found = keywords.first_keyword(get("documents").select("doc_id", "text"), "text", keys)
    return found.join(keys.select(F.initcap("keyword").alias("keyword"), "ord").groupBy("keyword").agg(F.min("ord").alias("ord")), "keyword", "left").select("doc_id", "ord")


_EDGES = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
_BINS = """WITH b AS (SELECT unnest(range(6)) AS bin), h AS (SELECT len(list_filter([0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], lambda e: e <= l_discount * 10)) - 1 AS bin, count(*) AS n FROM lineitem WHERE l_discount * 10 >= 0 AND l_discount * 10 < 1.0 GROUP BY 1)"""


@query(_BINS + " SELECT CAST(bin AS INT) AS bin, [0.0, 0.5, 0.6, 0.7, 0.8, 0.9][CAST(bin AS INT) + 1]::DOUBLE AS low, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bin)")
def a06_histogram(get):
    return rel.histogram(get("lineitem").select((C("l_discount") * 10).alias("x")), "x", _EDGES)


@query("WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY event_type) / sum(n) OVER (), 6) AS running_share FROM n")
def a07_w09_shares(get):
    rows = rel.shares(get("events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")
    return rows.withColumns({"share": R("share"), "running_share": R("running_share")})


@query("SELECT count(*) AS total, count(*) FILTER (clip > 0.1) AS clip, count(*) FILTER (clip > 0.1 AND l1 > 0.3) AS change, count(*) FILTER (clip > 0.1 AND l1 > 0.3 AND detected) AS found FROM {scores}")
def a08_funnel(get):
    return rel.funnel(get("scores"), {"clip": C("clip") > 0.1, "change": C("l1") > 0.3, "found": C("detected")})


@query("SELECT count(*) AS n FROM lineitem")
def a10_global_count(get):
    return get("lineitem").agg(F.count("*").alias("n"))


@query("SELECT coalesce(round(avg(n), 6), 0) AS mean_lines FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def a11_mean_observations(get):
    n = get("lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = get("orders").select("o_orderkey").join(n, "o_orderkey", "left")
    return rows.agg(F.coalesce(R(F.avg(F.coalesce("n", F.lit(0)))), F.lit(0.0)).alias("mean_lines"))


@query("SELECT name, round(sum(value * n), 4) AS total, sum(n)::BIGINT AS count, round(sum(value * n) / sum(n), 6) AS weighted_mean, round(sum(value * n) / (sum(n) + 1e-6), 6) AS global_avg FROM {meter} GROUP BY 1")
def a12_a14_meters(get):
    rows = rel.meters(get("meter"))
    return rows.select("name", R("total", 4).alias("total"), "count", R("weighted_mean").alias("weighted_mean"), R("global_avg").alias("global_avg"))


_PX = "(SELECT * FROM {pixels} WHERE label <> 255)"


@query(f"""WITH s AS (SELECT pred AS cls, 1 AS p, 0 AS l, CAST(pred = label AS INT) AS b FROM {_PX} UNION ALL SELECT label, 0, 1, 0 FROM {_PX}), t AS (SELECT cls, sum(p) AS p, sum(l) AS l, sum(b) AS b FROM s GROUP BY 1)
    SELECT cls, round(b / nullif(p + l - b, 0), 6) AS iou, round(b / nullif(l, 0), 6) AS acc, round(2 * b / nullif(p + l, 0), 6) AS dice, round(b / nullif(p, 0), 6) AS precision, round(b / nullif(l, 0), 6) AS recall,
        round(2 * (b / nullif(p, 0)) * (b / nullif(l, 0)) / nullif(b / nullif(p, 0) + b / nullif(l, 0), 0), 6) AS fscore FROM t""")
def a17_a18_segmentation_metrics(get):
    rows = rel.segmentation_metrics(get("pixels"))
    return rows.select("cls", *[R(c).alias(c) for c in rows.columns[1:]])


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT round(100.0 * avg(hit), 6) AS top3 FROM (SELECT o_custkey, max(CASE WHEN k <= 3 AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS hit FROM r GROUP BY 1)""")
def a19_top_k_accuracy(get):
    top = rel.last_k(get("orders").select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey").withColumn("o", F.struct((-C("o_totalprice")).alias("p"), "o_orderkey")), "o_custkey", C("o").asc(), 3)
    hit = top.groupBy("o_custkey").agg(F.max((C("o_orderpriority") == "1-URGENT").cast("int")).alias("hit"))
    return hit.agg(R(100.0 * F.avg("hit")).alias("top3"))


@query("SELECT image_id, arg_max(box_id, score * 1e12 - box_id) AS box_id FROM {boxes} GROUP BY 1")
def a21_best_of_n(get):
    """The greatest score; of equal ones the first."""
    return get("boxes").groupBy("image_id").agg(F.max_by("box_id", F.struct("score", (-C("box_id")).alias("first"))).alias("box_id"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def extension_cube(get):
    return get("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- windows, sorts, sets


_MOVING = """SELECT name, seq, value, list_sort(list(value) OVER w)[CAST((count(*) OVER w + 1) // 2 AS INT)] AS median, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS most FROM {meter}
    WINDOW w AS (PARTITION BY name ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@query(_MOVING)
def w01_w02_moving_meter(get):
    rows = rel.moving_meter(get("meter"), "name", "seq", "value")
    return rows.select("name", "seq", "value", "median", R("mean").alias("mean"), "most")


@query(_MOVING)
def w01_streamed_meter(get):
    """The same from a stream of the table, with state by name."""
    sink, mark = (shared_path(get.spark, x) for x in ("meters", "meters-mark"))
    named = lambda d: d.select(C("event_type").alias("name"), C("event_id").alias("seq"), "ts", "value")
    meters.run_keyed(get.spark, get.sf_dir, get("events").schema, lambda d: meters.moving_meters(named(d), idle_ms=1 << 40, late="36500 days"), sink, mark, glob="events.parquet")
    return get.spark.read.parquet(sink).where("not ended").select("name", "seq", "value", "median", R("mean").alias("mean"), "most")


@query("""SELECT name, seq, (sum(CAST(round(value * 100) AS BIGINT)) OVER w * (count(*) OVER (PARTITION BY name) - row_number() OVER w) // row_number() OVER w)::BIGINT AS eta_cents FROM {meter}
    WINDOW w AS (PARTITION BY name ORDER BY seq)""")
def w03_eta(get):
    """Running mean times what remains, in whole hundredths."""
    rows = rel.placed(get("meter").select("name", "seq", F.round(C("value") * 100).cast("long").alias("cents")), ["name"], "seq")
    counts = rows.groupBy("name").agg(F.count("*").alias("n"))
    rows = rel.running_sum(rows, ["name"], C("cents"), "s").withColumn("k", C("place") + 1).join(counts, "name")
    return rows.select("name", "seq", F.expr("s * (n - k) div k").alias("eta_cents"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS swap FROM events")
def w05_swapped_repeats(get):
    return rel.swapped_repeats(get("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id").select("event_id", "swap")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2")
def w06_latest_k(get):
    return rel.last_k(get("events").select("user_id", "event_id"), "user_id", C("event_id").desc(), 2).select("user_id", "event_id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations")
def w07_session_turns(get):
    w = Window.partitionBy("conv_id")
    return get("conversations").select("conv_id", "turn", (F.row_number().over(w.orderBy("turn")) - 1).alias("idx"), (C("turn") == F.max("turn").over(w)).alias("is_last"))


@query("""WITH t AS (SELECT image_id, box_id, CASE WHEN phrase = 'red dog' THEN 1 WHEN list_contains(['red', 'dog'], phrase) OR list_contains(string_split(phrase, ' '), 'dog') THEN 2 END AS tier FROM {boxes})
    SELECT image_id, box_id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY image_id) AS best FROM t WHERE tier IS NOT NULL) WHERE tier = best""")
def w08_f48_phrase_tiers(get):
    return vision.phrase_matches(get("boxes").withColumn("target", F.lit("red dog"))).select("image_id", "box_id", "tier")


@query("SELECT * FROM (SELECT user_id, lag(event_id) OVER w AS before, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE before IS NOT NULL")
def extension_lag(get):
    rows = rel.with_carried(rel.placed(get("events").select("user_id", "event_id"), ["user_id"], "event_id"), 1)
    rows = rows.select("user_id", "carried", F.lag("event_id").over(Window.partitionBy("user_id", "piece").orderBy("place")).alias("before"), "event_id")
    return rows.where("not carried and before is not null").select("user_id", "before", "event_id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) // 64 AS batch FROM customer")
def o06_u08_positions_and_batches(get):
    return rel.numbered(get("customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 64).select("c_custkey", "position", "batch")


@query("SELECT image_id, box_id, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS r FROM {boxes}) WHERE r <= 3")
def o10_o12_top_k_per_group(get):
    return rel.last_k(get("boxes").withColumn("o", F.struct((-C("score")).alias("s"), "box_id")), "image_id", C("o").asc(), 3).select("image_id", "box_id", "score")


@query("SELECT p_name AS name FROM part WHERE p_size < 10 UNION SELECT p_name FROM part WHERE p_size > 40")
def u02_union(get):
    p = get("part")
    return p.where("p_size < 10").select(C("p_name").alias("name")).union(p.where("p_size > 40").select("p_name")).distinct()


@query("SELECT p_brand AS v FROM part WHERE p_size < 25 EXCEPT SELECT p_brand FROM part WHERE p_size = 50 AND p_type = 'PROMO'")
def u03_difference(get):
    p = get("part")
    return p.where("p_size < 25").select(C("p_brand").alias("v")).subtract(p.where("p_size = 50 AND p_type = 'PROMO'").select("p_brand"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part")
def u04_u05_values_across_keys(get):
    return get("part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u06_intersection(get):
    return get("customer").select(C("c_nationkey").alias("k")).intersect(get("supplier").select("s_nationkey"))


@query("SELECT n_nationkey, CAST(k AS INT) AS repeat FROM nation, (SELECT unnest(range(3)) AS k)")
def u07_repeated(get):
    return rel.repeated(get("nation").select("n_nationkey"), 3)


@query("SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('two|' || user_id || '|' || event_id)) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= 2 AND n >= 2")
def d06_two_per_group(get):
    key = F.md5(F.concat_ws("|", F.lit("two"), C("user_id").cast("string"), C("event_id").cast("string")))
    rows = get("events").select("user_id", "event_id")
    two = rel.last_k(rows.withColumn("key", key), "user_id", C("key").asc(), 2).select("user_id", "event_id", C("rank").alias("r"))
    counts = rows.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2")
    return two.join(counts, "user_id").select("user_id", "event_id", "r", "n")


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) FILTER (length(text) > 20) = count(*)")
def d10_whole_sessions(get):
    """Sessions without a failed turn."""
    return get("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.length("text") > 20).alias("ok")).where("ok = turns").select("conv_id", "turns")


# --------------------------------------------------------------------------- vectors


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first FROM ({_V})")
def f40_unit_vectors(get):
    e = C("embedding")
    return get("embeddings").select("vec_id", R(v.norm(e)).alias("norm"), R(v.unit(e)[0]).alias("first"))


@query(f"WITH p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM ({_V}) a JOIN ({_V}) b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_dot_product(a, b), 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine FROM p")
def f41_dot_and_cosine(get):
    x = get("embeddings").select("vec_id", C("embedding").alias("a"))
    y = x.select((C("vec_id") - 1).alias("vec_id"), C("a").alias("b"))
    return x.join(y, "vec_id").select("vec_id", R(v.dot(C("a"), C("b"))).alias("dot"), R(v.cosine(C("a"), C("b"))).alias("cosine"))


@query("""SELECT row_id, round((l1 * clip + clip_dir * 0.5) / (sqrt(l1 * l1 + clip_dir * clip_dir) * sqrt(clip * clip + 0.25)), 6) AS direction FROM {scores} WHERE l1 + clip_dir > 0""")
def f43_direction_similarity(get):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    s = v.direction_similarity(zero, F.array("l1", "clip_dir"), zero, F.array(C("clip"), F.lit(0.5)))
    return get("scores").where("l1 + clip_dir > 0").select("row_id", R(s).alias("direction"))


@query("SELECT p_partkey, round((abs(p_size - 20) + abs(p_partkey % 200 - 100)) / 2.0 / 255, 6) AS plain, round((((p_size - 20) % 256 + 256) % 256 + ((p_partkey % 200 - 100) % 256 + 256) % 256) / 2.0 / 255, 6) AS wrapping FROM part")
def f44_pixel_distance(get):
    a, b = F.array(C("p_size").cast("long"), C("p_partkey") % 200), F.array(F.lit(20).cast("long"), F.lit(100).cast("long"))
    return get("part").select("p_partkey", R(v.pixel_distance(a, b)).alias("plain"), R(v.pixel_distance(a, b, wrapping=True)).alias("wrapping"))


@query("""WITH s AS (SELECT event_type, var_pop(value) AS va, var_pop(CAST(user_id AS DOUBLE)) AS vb, covar_samp(value, CAST(user_id AS DOUBLE)) AS c FROM events GROUP BY 1)
    SELECT event_type, round((c + 29.26125) / (sqrt(va) * sqrt(vb) + 29.26125), 5) AS structure FROM s""")
def f45_structure(get):
    u = C("user_id").cast("double")
    return get("events").groupBy("event_type").agg(R(v.structure(F.var_pop("value"), F.var_pop(u), F.covar_samp(C("value"), u)), 5).alias("structure"))


@query("SELECT row_id, CASE WHEN l1 = 0 THEN CAST('inf' AS DOUBLE) ELSE round(20 * log10(255 / sqrt(l1 * 100)), 6) END AS psnr, round(clip + 4 * l1, 6) AS composite, round(1 / (1 + exp(-clip)), 6) AS sigmoid, round(ln(greatest(clip, 1e-3) / greatest(1 - clip, 1e-3)), 6) AS logit FROM {scores}")
def f46_f50_scalars(get):
    return get("scores").select("row_id", R(v.psnr(C("l1") * 100)).alias("psnr"), R(C("clip") + 4 * C("l1")).alias("composite"), R(v.sigmoid(C("clip"))).alias("sigmoid"), R(v.logit(C("clip"))).alias("logit"))


@query("SELECT row_id, round(exp(clip) / (exp(clip) + exp(l1) + exp(clip_dir)), 6) AS p FROM {scores}")
def f49_softmax(get):
    return get("scores").select("row_id", R(v.softmax(F.array("clip", "l1", "clip_dir"))[0]).alias("p"))


@query("""WITH q AS (SELECT row_id, clip / n AS w, l1 / n AS x, clip_dir / n AS y, 0.5 / n AS z FROM (SELECT *, sqrt(clip * clip + l1 * l1 + clip_dir * clip_dir + 0.25) AS n FROM {scores}))
    SELECT row_id, round(1 - 2 * y * y - 2 * z * z, 6) AS m00, round(2 * x * y - 2 * w * z, 6) AS m01, round(2 * z * x - 2 * w * y, 6) AS m20, round(2 * (w * 0.6 + x * 0.8), 6) AS twice_w FROM q""")
def f51_f52_rotations(get):
    q = v.unit(F.array(C("clip"), C("l1"), C("clip_dir"), F.lit(0.5)))
    rows = get("scores").select("row_id", q.alias("q"))
    m = v.rotation(C("q"))
    turn = v.relative_rotation(F.array(F.lit(0.6), F.lit(0.8), F.lit(0.0), F.lit(0.0)), C("q"))
    return rows.select("row_id", R(m[0]).alias("m00"), R(m[1]).alias("m01"), R(m[6]).alias("m20"), R(2 * turn[0]).alias("twice_w"))


@query("SELECT vec_id, round(list_dot_product(e, list_transform(range(64), lambda i: (i - 32) / 100.0)) + 0.25, 6) AS grade FROM " + f"({_V})")
def m04_affine_grade(get):
    weights = F.array(*[F.lit((i - 32) / 100.0) for i in range(64)])
    return get("embeddings").select("vec_id", R(v.affine(C("embedding"), weights, 0.25)).alias("grade"))


@query(f"SELECT label, max_by(vec_id, round(e[1], 9) * 1e9 - vec_id / 1e6) AS vec_id FROM ({_V}) GROUP BY 1")
def m12_best_by_score(get):
    return get("embeddings").groupBy("label").agg(F.max_by("vec_id", F.struct(F.round(C("embedding")[0].cast("double"), 9), (-C("vec_id")).alias("i"))).alias("vec_id"))


# --------------------------------------------------------------------------- boxes and masks


@query("SELECT box_id, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h, round((x1 - x0) / 512 * ((y1 - y0) / 512), 6) AS share FROM {boxes}")
def g01_g05_conversions(get):
    b = bx.box(C("x0"), C("y0"), C("x1"), C("y1"))
    c = bx.center(b)
    return get("boxes").select("box_id", *[R(c[k]).alias(k) for k in ("cx", "cy", "w", "h")], R(bx.share_of_frame(b)).alias("share"))


@query("""WITH p AS (SELECT box_id, least(x1, 300) - greatest(x0, 100) AS iw, least(y1, 250) - greatest(y0, 50) AS ih, (x1 - x0) * (y1 - y0) + 40000 AS s, (greatest(x1, 300) - least(x0, 100)) * (greatest(y1, 250) - least(y0, 50)) AS hull FROM {boxes}),
    u AS (SELECT box_id, greatest(0, iw) * greatest(0, ih) AS i, s - greatest(0, iw) * greatest(0, ih) AS u, hull FROM p)
    SELECT box_id, round(i / u - (hull - u) / hull, 6) AS giou, round((i + 1e-6) / (u + 1e-6), 6) AS smoothed FROM u""")
def g03_g18_giou(get):
    a, b = bx.box(C("x0"), C("y0"), C("x1"), C("y1")), bx.box(F.lit(100.0), F.lit(50.0), F.lit(300.0), F.lit(250.0))
    return get("boxes").select("box_id", R(bx.giou(a, b)).alias("giou"), R(bx.iou_smoothed(a, b)).alias("smoothed"))


@query("SELECT box_id, least(greatest(x0 - 100, 0), 200) AS x0, least(greatest(y0 - 50, 0), 150) AS y0, least(greatest(x1 - 100, 0), 200) AS x1, least(greatest(y1 - 50, 0), 150) AS y1 FROM {boxes} WHERE least(greatest(x1 - 100, 0), 200) > least(greatest(x0 - 100, 0), 200) AND least(greatest(y1 - 50, 0), 150) > least(greatest(y0 - 50, 0), 150)")
def g22_f52_cropped(get):
    b = bx.clamp(bx.shifted(bx.box(C("x0"), C("y0"), C("x1"), C("y1")), F.lit(-100.0), F.lit(-50.0)), F.lit(200.0), F.lit(150.0))
    return get("boxes").select("box_id", b.alias("b")).where(bx.has_area(C("b"))).select("box_id", "b.x0", "b.y0", "b.x1", "b.y1")


@query("SELECT box_id, round(512 - x1, 6) AS x0, round(512 - x0, 6) AS x1, x0 <= 2 OR y0 <= 2 OR x1 >= 510 OR y1 >= 510 AS at_border, CASE WHEN (x0 + x1) / 2 < 256 THEN -1 ELSE 1 END AS side, CASE WHEN (y0 + y1) / 2 < 256 THEN -1 ELSE 1 END AS height FROM {boxes}")
def g20_f43_flips_and_quadrants(get):
    b = bx.box(C("x0"), C("y0"), C("x1"), C("y1"))
    f, q = bx.flipped(b, F.lit(512.0)), bx.quadrant(b)
    return get("boxes").select("box_id", R(f["x0"]).alias("x0"), R(f["x1"]).alias("x1"), bx.touches_border(b, F.lit(512.0), F.lit(512.0)).alias("at_border"), q["x"].alias("side"), q["y"].alias("height"))


def _counts():
    return F.array("c0", "c1", "c2", "c3", "c4")


@query("SELECT id, c1 + c3 AS area FROM {masks}")
def g08_rle_area(get):
    return get("masks").select("id", bx.rle_area(_counts()).alias("area"))


@query("SELECT id, coalesce(list_sum(list_concat(range(c0, c0 + c1), range(c0 + c1 + c2, c0 + c1 + c2 + c3)))::BIGINT, 0) AS positions FROM {masks}")
def g07_rle_pixels(get):
    return get("masks").select("id", F.aggregate(bx.rle_pixels(_counts()), F.lit(0).cast("long"), lambda s, x: s + x).alias("positions"))


@query("""WITH p AS (SELECT id, unnest(list_concat(range(c0, c0 + c1), range(c0 + c1 + c2, c0 + c1 + c2 + c3))) AS p FROM {masks})
    SELECT id, coalesce(min(p // 8), 0) AS x0, coalesce(min(p % 8), 0) AS y0, coalesce(max(p // 8), 0) AS x1, coalesce(max(p % 8), 0) AS y1 FROM {masks} LEFT JOIN p USING (id) GROUP BY id""")
def g04_mask_boxes(get):
    return vision.mask_boxes(get("masks").select("id", "h", _counts().alias("counts")))


@query("SELECT id, round(len(list_filter(a, lambda x: x >= 10 AND x < 30)) / nullif(len(a), 0), 6) AS share FROM (SELECT id, list_concat(range(c0, c0 + c1), range(c0 + c1 + c2, c0 + c1 + c2 + c3)) AS a FROM {masks})")
def g09_f39_mask_overlap(get):
    rows = get("masks")
    other = rows.select("id", F.array(*[F.lit(n).cast("long") for n in (10, 20, 34)]).alias("counts"))
    out = vision.pixel_overlap(rows.select("id", _counts().alias("counts")), other)
    return out.select("id", R("share").alias("share"))


_SIZED = "SELECT n_nationkey AS image_id, n_nationkey * 40 + 300 AS w, n_nationkey * 10 + 400 AS h FROM nation"


def _sized(get):
    return get("nation").select(C("n_nationkey").alias("image_id"), (C("n_nationkey") * 40 + 300).alias("w"), (C("n_nationkey") * 10 + 400).alias("h"))


@query(f"SELECT image_id, round((j + 0.5) / 32 * w, 6)::DOUBLE AS x, round((i + 0.5) / 32 * h, 6)::DOUBLE AS y FROM ({_SIZED}), (SELECT unnest(range(32)) AS i), (SELECT unnest(range(32)) AS j)")
def g12_point_grid(get):
    return vision.grid(_sized(get), 32).select("image_id", R("x").alias("x"), R("y").alias("y"))


@query(f"""WITH l AS (SELECT image_id, w, h, layer::INT AS layer, (2 ** layer)::BIGINT AS per, CASE WHEN layer = 0 THEN 0 ELSE floor(least(w, h) * (512 / 1500.0::DOUBLE) * 2 / (2 ** layer))::BIGINT END AS o, 32 // (2 ** layer)::BIGINT AS n FROM ({_SIZED}), (SELECT unnest(range(3)) AS layer)),
    c AS (SELECT *, ceil((o * (per - 1) + w) / per::DOUBLE)::BIGINT AS cw, ceil((o * (per - 1) + h) / per::DOUBLE)::BIGINT AS ch FROM l),
    b AS (SELECT image_id, layer, n, (cw - o) * a AS x0, (ch - o) * b AS y0, least((cw - o) * a + cw, w) AS x1, least((ch - o) * b + ch, h) AS y1 FROM (SELECT *, unnest(range(per)) AS a FROM c), unnest(range(per)) u(b))
    SELECT image_id, layer, round(x0 + (j + 0.5::DOUBLE) / n * (x1 - x0), 6) AS x, round(y0 + (i + 0.5::DOUBLE) / n * (y1 - y0), 6) AS y FROM (SELECT *, unnest(range(n)) AS i FROM b), unnest(range(n)) v(j)""")
def g12_layered_grids(get):
    """Points of each image as a whole and of the crops of two layers."""
    return vision.layered_grids(_sized(get), 32, 2, 2).select("image_id", "layer", R("x").alias("x"), R("y").alias("y"))


@query("""WITH n AS (SELECT n_nationkey AS image_id, n_nationkey * 40 + 300 AS w, 400 AS h FROM nation), x AS (SELECT image_id, h, unnest(list_distinct(list_append(range(0, w - 256, 200), w - 256))) AS x FROM n)
    SELECT image_id, CAST(x AS INT) AS x, CAST(unnest(list_distinct(list_append(range(0, h - 256, 200), h - 256))) AS INT) AS y FROM x""")
def g23_patches(get):
    return vision.patches(get("nation").select(C("n_nationkey").alias("image_id"), (C("n_nationkey") * 40 + 300).alias("w"), F.lit(400).alias("h")), 256, 200)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS side, ('0x' || substr(md5('s|' || doc_id), 1, 8))::BIGINT % 10 AS bucket FROM documents")
def d04_bounded_draws(get):
    return get("documents").select("doc_id", F.when(C("doc_id") % 3 == 0, "a").otherwise("b").alias("side"), (sm.draw(C("doc_id"), "s") % 10).alias("bucket"))
