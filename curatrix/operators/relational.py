"""Joins, groupings, windows and partitions that the curation steps share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.sampling import draw
from curatrix.operators.similarity import grid_pairs


# --------------------------------------------------------------------------- joins


def keep_last(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key, that with the greatest position. An aggregate, not a window: it combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def back_filled(results: DataFrame, sources: DataFrame, key: str, fill: list[str], position: str) -> DataFrame:
    """results with nulls in `fill` taken from the last source of the same key; rows without a source stay."""
    last = keep_last(sources.select(key, position, *fill), key, position).select(key, *[F.col(c).alias(f"src_{c}") for c in fill])
    out = results.join(last, key, "left")
    return out.select(*[F.coalesce(c, f"src_{c}").alias(c) if c in fill else F.col(c) for c in results.columns])


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the finished ones: what a restarted job has left to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def value_pairs(rows: DataFrame, value: str, position: str) -> DataFrame:
    """(first, second) for each unordered pair of distinct values, the one that was seen first in front. Pairs are
    what is asked for, so their number is the square of that of the distinct values."""
    one = rows.groupBy(value).agg(F.min(position).alias("pos"))
    pairs = grid_pairs(one, value, F.col("a.pos") < F.col("b.pos"))
    return pairs.select(F.col("a")[value].alias("first"), F.col("b")[value].alias("second"))


def pairs_within(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs of rows of one group, the smaller key in front, as structs a and b."""
    whole = F.struct(*rows.columns)
    a = rows.select(F.col(group).alias("g"), F.col(key).alias("ka"), whole.alias("a"))
    b = rows.select(F.col(group).alias("g"), F.col(key).alias("kb"), whole.alias("b"))
    return a.join(b, "g").where("ka < kb").select(F.col("g").alias(group), "a", "b")


# --------------------------------------------------------------------------- groupings


def merged_lists(parts: list[DataFrame], key: str, values: str) -> DataFrame:
    """One list per key: those of the first part, then those of the second, repeats kept."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select(key, values, F.lit(i).alias("part"))
        rows = p if rows is None else rows.unionByName(p)
    found = F.array_sort(F.collect_list(F.struct("part", values)))
    return rows.groupBy(key).agg(F.flatten(F.transform(found, lambda s: s[values])).alias(values))


def word_groups(rows: DataFrame, name: str) -> DataFrame:
    """How many names of several words end in a word; one more if the word is a name itself."""
    last = F.element_at(F.split(name, " "), -1)
    ends = rows.where(F.contains(F.col(name), F.lit(" "))).groupBy(last.alias("word")).agg(F.count("*").alias("n"))
    own = rows.select(F.col(name).alias("word"), F.lit(1).alias("own")).distinct()
    return ends.join(own, "word", "left").select("word", (F.col("n") + F.coalesce("own", F.lit(0))).alias("n"))


def histogram(rows: DataFrame, value: str, edges: list[float], close_top: bool = False) -> DataFrame:
    """(bin, low, n) for each interval from an edge up to the next, empty ones too; values outside count nowhere.
    close_top: the last one holds its upper edge."""
    v = F.col(value)
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= v)) - 1
    if close_top:
        at = F.when(v == edges[-1], len(edges) - 2).otherwise(at)
    found = rows.select(at.alias("bin")).where(F.col("bin").between(0, len(edges) - 2)).groupBy("bin").agg(F.count("*").alias("n"))
    bins = rows.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, edges[:-1]))).alias("bin", "low"))
    return bins.join(found, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).alias("n"))


def shares(counts: DataFrame, order: str, n: str) -> DataFrame:
    """counts with share and running_share of the total; counts are few rows."""
    whole, so_far = F.sum(n).over(Window.partitionBy()), F.sum(n).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"share": F.col(n) / whole, "running_share": so_far / whole})


def funnel(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """One row: total, and for each step how many rows pass it and all before it."""
    out, so_far = [F.count("*").alias("total")], F.lit(True)
    for name, rule in steps.items():
        so_far = so_far & F.coalesce(rule, F.lit(False))
        out.append(F.count_if(so_far).alias(name))
    return rows.agg(*out)


def segmentation_metrics(pixels: DataFrame, ignore: int = 255, beta: float = 1.0) -> DataFrame:
    """By class over rows (pred, label): iou, acc, dice, precision, recall, fscore; null where nothing counts.
    Rows labelled `ignore` are left out."""
    rows = pixels.where(F.col("label") != ignore)
    sides = rows.select(F.explode(F.array(
        F.struct(F.col("pred").alias("cls"), F.lit(1).alias("p"), F.lit(0).alias("l"), (F.col("pred") == F.col("label")).cast("int").alias("both")),
        F.struct(F.col("label").alias("cls"), F.lit(0).alias("p"), F.lit(1).alias("l"), F.lit(0).alias("both")),
    )).alias("s")).select("s.*")
    t = sides.groupBy("cls").agg(F.sum("p").alias("p"), F.sum("l").alias("l"), F.sum("both").alias("both"))
    precision, recall = F.try_divide("both", "p"), F.try_divide("both", "l")
    return t.select(
        "cls", F.try_divide(F.col("both"), F.col("p") + F.col("l") - F.col("both")).alias("iou"), recall.alias("acc"), F.try_divide(2 * F.col("both"), F.col("p") + F.col("l")).alias("dice"),
        precision.alias("precision"), recall.alias("recall"), F.try_divide((1 + beta**2) * precision * recall, beta**2 * precision + recall).alias("fscore"),
    )


def meters(series: DataFrame, name: str = "name", value: str = "value", n: str = "n") -> DataFrame:
    """By name: total, count, mean weighted by n, and the mean with a millionth added to the count."""
    total = F.sum(F.col(value) * F.col(n))
    return series.groupBy(name).agg(total.alias("total"), F.sum(n).alias("count"), (total / F.sum(n)).alias("weighted_mean"), (total / (F.sum(n) + 1e-6)).alias("global_avg"))


# --------------------------------------------------------------------------- windows


STRETCH = 50_000


def placed(rows: DataFrame, group: list[str], order: str, stretch: int = STRETCH) -> DataFrame:
    """rows with `place`, from 0 on within the group, and `piece`, the number of its stretch of `stretch` rows: a
    window partitioned by group and piece holds no more rows than that, however large the group. Rows are numbered within
    group and range of `order`, and the counts of these, few rows a group, give each its first place. Columns of group and
    order are not null, and unique together."""
    ranged = in_ranges(rows, [order])
    counts = ranged.groupBy(*group, "range").agg(F.count("*").alias("rows_in"))
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "range", F.coalesce(F.sum("rows_in").over(earlier), F.lit(0)).alias("first"))
    inner = F.row_number().over(Window.partitionBy(*group, "range").orderBy(order)) - 1
    out = ranged.withColumn("inner", inner).join(starts, [*group, "range"]).withColumn("place", (F.col("inner") + F.col("first")).cast("long"))
    return out.select(*rows.columns, "place", F.floor(F.col("place") / stretch).alias("piece"))


def with_carried(rows: DataFrame, before: int, stretch: int = STRETCH) -> DataFrame:
    """placed() rows with `carried`: each stretch also holds the last `before` rows of the one before it, so that
    frames of so many rows see what they need; drop them after the window."""
    late = F.col("place") % stretch >= stretch - before
    pieces = F.when(late, F.array(F.struct(F.col("piece").alias("p"), F.lit(False).alias("c")), F.struct((F.col("piece") + 1).alias("p"), F.lit(True).alias("c"))))
    rows = rows.withColumn("in", F.explode(pieces.otherwise(F.array(F.struct(F.col("piece").alias("p"), F.lit(False).alias("c"))))))
    return rows.withColumn("piece", F.col("in.p")).withColumn("carried", F.col("in.c")).drop("in")


def running_sum(rows: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """placed() rows with the sum of value over the rows of the group up to each: stretches sum up by themselves, and
    one row a stretch carries what came before."""
    totals = rows.groupBy(*group, "piece").agg(F.sum(value).alias("whole"))
    earlier = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "piece", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("earlier"))
    inner = F.sum(value).over(Window.partitionBy(*group, "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, inner).join(totals, [*group, "piece"]).withColumn(name, F.col(name) + F.col("earlier")).drop("earlier")


def moving_meter(series: DataFrame, name: str, order: str, value: str, size: int = 20, stretch: int = STRETCH) -> DataFrame:
    """By row, over the last `size` rows of its name: lower median, mean and maximum."""
    w = Window.partitionBy(name, "piece").orderBy("place").rowsBetween(-(size - 1), 0)
    held = F.sort_array(F.collect_list(value).over(w))
    rows = with_carried(placed(series, [name], order, stretch), size - 1, stretch)
    rows = rows.withColumns({"median": F.element_at(held, ((F.size(held) + 1) / 2).cast("int")), "mean": F.avg(value).over(w), "most": F.max(value).over(w)})
    return rows.where("not carried").select(*series.columns, "median", "mean", "most")


def last_k(rows: DataFrame, group: str, order: Column, k: int) -> DataFrame:
    """The k greatest rows of each group by `order`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("rank") <= k)


def first_k(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """(group, item): an array of the k smallest items of each group. Spark drops all but k rows a group in each task
    before they travel."""
    least = last_k(rows.select(group, item), group, F.col(item).asc(), k)
    return least.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias(item))


def lowest_tier(rows: DataFrame, group: str, tier: Column) -> DataFrame:
    """Of each group only the rows of its lowest tier; rows without a tier go."""
    rows = rows.withColumn("tier", tier).where("tier is not null")
    return rows.withColumn("best", F.min("tier").over(Window.partitionBy(group))).where("tier = best").drop("best")


def swapped_repeats(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """rows with `swap`: whether a row of its group came before. Values of `order` differ within a group."""
    first = rows.groupBy(*group).agg(F.min(order).alias("first"))
    return rows.join(first, group).withColumn("swap", F.col(order) > F.col("first")).drop("first")


# --------------------------------------------------------------------------- partitions


def shard(rows: DataFrame, key: str, shards: int, seed: str = "shard") -> DataFrame:
    """rows with the shard each belongs to: disjoint, complete, and decided by key and seed alone."""
    return rows.withColumn("shard", (draw(F.col(key), seed) % shards).cast("int"))


SAMPLED = 50  # keys a range that decide where it begins


def in_ranges(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with `range`: which of `ranges` (by default as many as shuffle partitions) parts of about equal numbers of rows
    they are in by their order. The cuts are those of a sample by hash, one array that the plan itself computes; each row
    finds its range by bisection."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(F.struct(*order).alias("key"), F.xxhash64(*order).alias("h")).orderBy("h").limit(SAMPLED * ranges)
    found = keys.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    at = F.sequence(F.lit(1), F.lit(max(1, ranges - 1)))
    cuts = F.transform(at, lambda i: F.get("keys", F.floor(F.size("keys") * i / F.lit(ranges)).cast("int")))
    cuts = found.select(F.filter(cuts, lambda c: c.isNotNull()).alias("cuts")).scalar()
    rows = rows.withColumns({"cuts": cuts, "key": F.struct(*order)})
    steps = F.array(*[F.lit(1 << k) for k in range(ranges.bit_length() - 1, -1, -1)])
    beyond = lambda at: (at <= F.size("cuts")) & (F.get("cuts", at - 1) <= F.col("key"))
    return rows.withColumn("range", F.aggregate(steps, F.lit(0), lambda at, step: F.when(beyond(at + step), at + step).otherwise(at))).drop("cuts", "key")


def numbered(rows: DataFrame, order: list[str], size: int, ranges: int | None = None) -> DataFrame:
    """rows with position (from 0) and batch of `size` rows in a total order, without one task for all of them: rows are
    numbered within their range, and the counts of the ranges, a row each, give each its first position. Columns of `order`
    are unique together, and not null."""
    ranged = in_ranges(rows, order, ranges)
    counts = ranged.groupBy("range").agg(F.count("*").alias("rows_in"))
    before = F.coalesce(F.sum("rows_in").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    out = ranged.withColumn("inner", inner).join(F.broadcast(starts), "range")  # a row per range
    position = (F.col("inner") + F.col("before")).cast("long")
    return out.select(*rows.columns, position.alias("position"), F.floor(position / size).alias("batch"))


def repeated(rows: DataFrame, times: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("repeat"))
