"""Operators on boxes and masks that need more than a Column: suppression, components, run lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import boxes as bx
from curatrix.functions import runs

BOX = ("x0", "y0", "x1", "y1")


def _ranked(boxes: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """The boxes of each group as an array, by score and then box_id: groups are images, and stay small."""
    item = F.struct((-F.col("score")).alias("order"), "box_id", "score", *BOX, *rest)
    return boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("found"))


def suppressed(boxes: DataFrame, group: str, threshold: float = 0.5, by_class: str | None = None) -> DataFrame:
    """Greedy non-maximum suppression over rows (group, box_id, score, x0, y0, x1, y1): of each group the boxes that
    overlap no kept one of a greater score (then smaller box_id) by more than threshold. by_class: boxes of different
    classes never suppress each other."""
    keys = [group] + ([by_class] if by_class else [])
    rest = [c for c in boxes.columns if c not in (*keys, "box_id", "score", *BOX)]
    kind = _ranked(boxes, keys, rest)
    none = F.filter("found", lambda x: F.lit(False))
    near = lambda a, b: F.coalesce(bx.iou(a, b) > threshold, F.lit(False))
    kept = F.aggregate("found", none, lambda kept, x: F.when(F.exists(kept, lambda k: near(k, x)), kept).otherwise(F.array_append(kept, x)))
    rows = kind.select(*keys, F.explode(kept).alias("x"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"x.{c}") for c in boxes.columns])


CELLS = 1 << 18  # boxes, padded to groups of one width, that are softened at once


def _ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """bx.iou of boxes (x0, y0, x1, y1 first): 0 without an area."""
    w, h = (np.maximum(0, np.minimum(a[k + 2], b[k + 2]) - np.maximum(a[k], b[k])) for k in (0, 1))
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return np.where(union == 0, 0, both / np.where(union == 0, 1, union))


def _softened(score: np.ndarray, box: np.ndarray, known: np.ndarray, same: np.ndarray, alive: np.ndarray, lower: Callable, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(score at which it was kept, kept) of each box of groups, a row each, by order of box_id; all groups go on by one
    box at a time. known: has all of its corners; same: numbers that boxes of one box_id share. NaN is over any `least`,
    and the last to be kept, as in Spark."""
    out, kept, at = np.zeros(score.shape), np.zeros(score.shape, bool), np.arange(len(score))
    alive = alive & ~(score <= least)
    while True:
        some = alive.any(1)
        at, score, box, known, same, alive = at[some], score[some], box[:, some], known[some], same[some], alive[some]
        if not len(at):
            return out, kept
        row, top = np.arange(len(at)), np.where(alive, np.where(np.isnan(score), np.finfo(float).min, score), -np.inf).argmax(1)
        out[at, top], kept[at, top] = score[row, top], True
        iou = np.where(known & known[row, top][:, None], _ious(box[:, row, top][:, :, None], box), 0)
        score = score * lower(iou)
        alive = alive & (same != same[row, top][:, None]) & ~(score <= least)


def softly_suppressed(boxes: DataFrame, group: str, threshold: float = 0.3, sigma: float = 0.5, least: float = 1e-3, gaussian: bool = False) -> DataFrame:
    """Soft suppression: the box of the greatest score (then smallest box_id) is kept, the scores of the rest fall by
    their overlap with it, and so on. Linear: by 1 - IoU where the IoU is over threshold; gaussian: by
    exp(-IoU * IoU / sigma). Boxes whose score falls to `least` or below are dropped. `score` is that at which a box
    was kept."""
    rest = [c for c in boxes.columns if c not in (group, "box_id", "score", *BOX)]
    kind = boxes.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("box_id", "score", *BOX, *rest))).alias("found"))

    def lower(iou: np.ndarray) -> np.ndarray:
        return np.exp(-iou * iou / sigma) if gaussian else np.where(iou <= threshold, 1.0, 1 - iou)

    def run(ids: pa.Array, *numbers: pa.Array) -> pa.Array:
        size = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        flat, ids = [x.flatten() for x in numbers], ids.flatten()
        there = np.array([x.is_valid().to_numpy(zero_copy_only=False) for x in flat])
        score, *box = (x.fill_null(0.0).to_numpy(zero_copy_only=False) for x in flat)
        box, known = np.array(box), there[1:].all(0)
        other = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)  # ids are in order
        if ids.null_count:
            null = ids.is_null().to_numpy(zero_copy_only=False)
            other = other & ~(null[1:] & null[:-1])
        same = np.concatenate(([0], np.cumsum(other)))
        out, kept = np.zeros(len(score)), np.zeros(len(score), bool)
        order, wide = np.argsort(size, kind="stable"), np.sort(size)
        k = 0
        with np.errstate(all="ignore"):
            while k < len(order):
                most = max(1, CELLS // max(1, 2 * int(wide[k])))
                some = order[k : min(k + most, int(np.searchsorted(wide, 2 * wide[k], "right")))]
                k += len(some)
                spots = (ends - size)[some][:, None] + np.arange(size[some].max())
                inside = np.arange(spots.shape[1]) < size[some][:, None]
                spots = np.where(inside, spots, 0)
                if not inside.any():
                    continue
                s, have = _softened(score[spots], box[:, spots], known[spots], same[spots], there[0][spots] & inside, lower, least)
                out[spots[have]], kept[spots[have]] = s[have], True
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(out, mask=~kept))

    numbers = [F.col("found")[c].cast("array<double>") for c in ("score", *BOX)]
    rows = kind.withColumn("kept", F.arrow_udf(run, "array<double>")(F.col("found")["box_id"], *numbers))
    rows = rows.select(group, F.explode_outer(F.arrays_zip("found", "kept")).alias("x")).where("x.kept is not null")  # outer, or Spark does the work twice, to drop empty lists first
    return rows.select(*[F.col(c) if c == group else F.col("x.kept").alias(c) if c == "score" else F.col(f"x.found.{c}") for c in boxes.columns])


def enough_per_group(rows: DataFrame, group: str, order: Column, n: Column) -> DataFrame:
    """The first n rows of each group by `order`, n a column of the group; groups of fewer rows, or of one, go."""
    w = Window.partitionBy(group)
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(order))).withColumn("of", F.count("*").over(w))
    return rows.where((F.col("rank") <= n) & (F.col("of") >= n) & (F.col("of") > 1)).drop("of")


def any_overlap(boxes: DataFrame, others: DataFrame, group: str) -> DataFrame:
    """The rows of `boxes` (with a struct `box`) that overlap one of `others` in their group."""
    o = others.select(F.col(group).alias("o_group"), F.col("box").alias("o_box"))
    return boxes.join(o, (boxes[group] == o["o_group"]) & bx.overlap(F.col("box"), F.col("o_box")), "left_semi")


def phrase_matches(detections: DataFrame, target: str = "target") -> DataFrame:
    """Detections whose phrase is the target of their image; where an image has none, those whose phrase is a word
    of the target or holds its last word."""
    from curatrix.operators.relational import lowest_tier

    phrase, t = F.col("phrase"), F.col(target)
    loose = F.array_contains(F.split(t, " "), phrase) | F.array_contains(F.split(phrase, " "), F.element_at(F.split(t, " "), -1))
    return lowest_tier(detections, "image_id", F.when(phrase == t, 1).when(loose, 2))


def pixel_overlap(masks: DataFrame, others: DataFrame) -> DataFrame:
    """(id, share): of each run-length mask (id, counts) the share of its pixels that the other mask of its id has."""
    both = masks.join(others.select("id", F.col("counts").alias("o_counts")), "id", "left")
    shared = F.coalesce(bx.rle_area(runs.intersection(F.col("counts"), F.col("o_counts"))), F.lit(0))
    return both.select("id", F.try_divide(shared, bx.rle_area(F.col("counts"))).alias("share"))


def mask_boxes(masks: DataFrame) -> DataFrame:
    """(id, x0, y0, x1, y1) of column-major run-length masks (id, h, counts); zeros for empty ones."""
    rows = masks.select("id", runs.mask_box(F.col("counts"), F.col("h")).alias("b"))
    return rows.select("id", *[F.col("b")[i].alias(c) for i, c in enumerate(BOX)])


HELD = 1024  # groups whose unions a task holds at once


def merged_masks(masks: DataFrame, group: str) -> DataFrame:
    """(group, counts) of the pixels that any mask of the group has: masks (group, counts). Tasks unite what they hold of
    a group before it travels, so a group of any size meets as one mask a task."""
    kind = masks.schema[group].dataType.simpleString()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            lists = pa.array([runs.counts_of(s, n).tolist() for s, n in held.values()], pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), keys), lists], [group, "counts"])
            held.clear()
            return batch

        for x in batches:
            keys = x.column(0).type
            for key, counts in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                c = np.array(counts or [], np.int64)
                start, end = runs.spans_of(c)
                (s, e), n = held.get(key, ((start[:0], end[:0]), 0))
                if key not in held and len(held) == HELD:
                    yield out()
                held[key] = runs.united(np.concatenate((s, start)), np.concatenate((e, end))), max(n, int(c.sum()))
        if held:
            yield out()

    schema = f"`{group}` {kind}, counts array<long>"
    part = masks.select(group, "counts").mapInArrow(unite, schema)
    return part.repartition(group).sortWithinPartitions(group).mapInArrow(unite, schema)


def _labels(col: np.ndarray, top: np.ndarray, end: np.ndarray, h: int) -> np.ndarray:
    """The number of the first run of the component of each run, sorted by column and row: runs of neighbouring columns
    touch by sides or corners."""
    label = np.arange(len(col))
    low = np.searchsorted(col * (h + 1) + end, (col + 1) * (h + 1) + top)  # the first of the next column that reaches as far as the row above this one
    n = np.maximum(np.searchsorted(col * (h + 1) + top, (col + 1) * (h + 1) + end, "right") - low, 0)
    a = np.repeat(label, n)
    b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


@dataclass
class _Parts:
    """The components of the masks of a batch: col, top, end, mask of each run, and the number of its component, by which
    first (its first run), of (its mask) and area go."""

    values: np.ndarray
    n: np.ndarray
    h: int
    on: bool

    def __post_init__(self) -> None:
        ends = np.append(0, np.cumsum(self.values))
        self.sizes = ends[np.cumsum(self.n)] - ends[np.cumsum(self.n) - self.n]
        self.step = int(self.sizes.max(initial=0)) + 1
        self.col, self.top, self.end, self.mask = runs.columns_of(runs.laid_out(self.values, self.n, self.step, self.on), self.h, self.step)
        label = _labels(self.col + self.mask * (self.step // self.h + 3), self.top, self.end, self.h)
        self.first, self.part = np.unique(label, return_inverse=True)
        self.of = self.mask[self.first]
        self.area = np.bincount(self.part, self.end - self.top, len(self.first)).astype(np.int64)


def _by_mask(masks: DataFrame, schema: str, on: bool, work: Callable[[_Parts], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """(id, ...) rows that `work` makes, as numbers of masks and columns, of the components of masks (id, h, counts). Those
    of one height of a batch are worked on at once."""
    kind = masks.schema["id"].dataType.simpleString()
    names = ["id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            tall = x.column("h").to_numpy(zero_copy_only=False)
            for h in np.unique(tall).tolist():
                y = x.take(pa.array(np.flatnonzero(tall == h)))
                n = pc.coalesce(pc.list_value_length(y.column("counts")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = y.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.append(0, np.cumsum(n))
                largest = max((int(values[ends[i] : ends[i + 1]].sum()) for i in range(len(n))), default=0) if len(values) and values.max() > 1 << 30 else int(values.sum())
                many = max(1, (1 << 60) // (largest + 4 * h + 4))
                for at in range(0, len(n), many):
                    part = n[at : at + many]
                    rows, columns = work(_Parts(values[ends[at] : ends[at + len(part)]], part, int(h), on))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([y.column("id").take(pa.array(rows + at)), *columns], names)

    return masks.select("id", "h", "counts").mapInArrow(run, f"id {kind}, {schema}")


def components(masks: DataFrame, on: bool = True) -> DataFrame:
    """(id, component, area) of the connected parts, by sides and corners, of the pixels that are on, or off, of
    column-major run-length masks (id, h, counts). component: the position of its first pixel. Empty masks have none."""

    def work(p: _Parts) -> tuple[np.ndarray, list[pa.Array]]:
        return p.of, [pa.array(p.col[p.first] * p.h + p.top[p.first]), pa.array(p.area)]

    return _by_mask(masks, "component long, area long", on, work)


def without_small(masks: DataFrame, least: int, holes: bool = False) -> DataFrame:
    """(id, counts, changed): masks without islands of fewer than `least` pixels, of which the largest stays if all are
    small; or, with `holes`, with such holes filled."""

    def work(p: _Parts) -> tuple[np.ndarray, list[pa.Array]]:
        small = p.area < least
        m = len(p.n)
        changed = np.bincount(p.of[small], minlength=m) > 0
        if not holes:
            order = np.lexsort((p.first, -p.area, p.of))  # of equal ones that with the first pixel stays
            small[order[np.append(True, np.diff(p.of[order]) > 0)[: len(order)]]] = False
        use = small[p.part] if holes else ~small[p.part]
        at = p.mask[use] * p.step + p.col[use] * p.h
        start, end = at + p.top[use], at + p.end[use]
        if holes:
            was = runs.laid_out(p.values, p.n, p.step)
            start, end = np.concatenate((was[0], start)), np.concatenate((was[1], end))
        new, n = runs.lists_of(runs.united(start, end), p.sizes, p.step)
        keep, made = ~np.repeat(changed, p.n), np.repeat(changed, n)  # what does not change stays as it is coded
        row = np.concatenate((np.repeat(np.arange(m), p.n)[keep], np.repeat(np.arange(m), n)[made]))
        values = np.concatenate((p.values[keep], new[made]))[np.argsort(row, kind="stable")]
        ends = np.concatenate(([0], np.cumsum(np.where(changed, n, p.n)))).astype(np.int32)
        return np.arange(m), [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(changed)]

    return _by_mask(masks, "counts array<long>, changed boolean", not holes, work)


def occlusion(parts: DataFrame, threshold: float = 0.15, least: int = 50) -> DataFrame:
    """(id, largest, occluded) from components(): parts of fewer than `least` pixels are noise; the share of the largest
    of the others, null if there is none, and whether it leaves more than threshold to them."""
    kept = F.when(F.col("area") >= least, F.col("area"))
    share = F.max(kept) / F.sum(kept)
    return parts.groupBy("id").agg(share.alias("largest"), F.coalesce(share < 1 - threshold, F.lit(False)).alias("occluded"))


def connectivity(parts: DataFrame, least: int = 10) -> DataFrame:
    """(id, score) from components(): the share of the largest part; 0 for masks of fewer than `least` pixels."""
    whole = F.sum("area")
    return parts.groupBy("id").agg(F.when(whole < least, 0.0).otherwise(F.max("area") / whole).alias("score"))


def grid(images: DataFrame, side: int) -> DataFrame:
    """(image_id, x, y) of side x side points of each image (image_id, w, h), each in the middle of its cell."""
    return layered_grids(images, side, 0, 1).drop("layer")


def layered_grids(images: DataFrame, side: int, layers: int, scale: int) -> DataFrame:
    """(image_id, layer, x, y): a grid for each image (image_id, w, h) as a whole, and for each layer one for every crop of
    crop_boxes(), of a side that is `scale` times smaller from layer to layer, in whole points: in pixels of the image.
    Layers whose side comes to nothing have none."""
    sides = F.array(*[F.lit(int(side / scale**i)) for i in range(layers + 1)])
    rows = crop_boxes(images, layers).withColumn("n", F.get(sides, F.col("layer"))).where("n > 0")
    steps = F.sequence(F.lit(0), F.col("n") - 1)
    rows = rows.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    along = lambda low, high, k: F.col(low) + (F.col(k) + 0.5) / F.col("n") * (F.col(high) - F.col(low))
    return rows.select("image_id", "layer", along("x0", "x1", "j").alias("x"), along("y0", "y1", "i").alias("y"))


def crop_boxes(images: DataFrame, layers: int, overlap: float = 512 / 1500) -> DataFrame:
    """(image_id, layer, x0, y0, x1, y1): the whole image, then for each layer 2**layer by 2**layer crops that
    overlap by a share of the shorter side, clipped to the image."""
    per = F.pow(F.lit(2), F.col("layer")).cast("int")
    over = F.floor(F.least("w", "h") * overlap * 2 / per)
    rows = images.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer")).withColumns({"per": per, "over": over})
    width = lambda side: F.ceil((F.col("over") * (F.col("per") - 1) + F.col(side)) / F.col("per"))
    rows = rows.withColumns({"cw": width("w"), "ch": width("h"), "i": F.explode(F.sequence(F.lit(0), F.col("per") - 1))})
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("per") - 1)))
    x0, y0 = (F.col("cw") - F.col("over")) * F.col("i"), (F.col("ch") - F.col("over")) * F.col("j")
    whole = F.col("layer") == 0
    at = lambda v: F.when(whole, F.lit(0)).otherwise(v).cast("long")
    return rows.select("image_id", "layer", at(x0).alias("x0"), at(y0).alias("y0"), F.least(F.when(whole, F.col("w")).otherwise(x0 + F.col("cw")), F.col("w")).cast("long").alias("x1"), F.least(F.when(whole, F.col("h")).otherwise(y0 + F.col("ch")), F.col("h")).cast("long").alias("y1"))


def patches(images: DataFrame, size: int, step: int) -> DataFrame:
    """(image_id, x, y): top left corners of patches every `step`, the last ones moved back to end at the edge; an
    image no larger than a patch is one."""
    def starts(side: str):
        s = F.col(side)
        inner = F.sequence(F.lit(0), F.greatest(s - size - 1, F.lit(0)), F.lit(step))
        return F.when(s > size, F.array_distinct(F.concat(inner, F.array(s - size)))).otherwise(F.array(F.lit(0).cast(images.schema[side].dataType)))

    return images.select("image_id", F.explode(starts("w")).alias("x"), "h").select("image_id", "x", F.explode(starts("h")).alias("y"))
