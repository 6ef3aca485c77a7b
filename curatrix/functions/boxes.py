"""Column expressions over boxes, structs (x0, y0, x1, y1), and over run-length masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def center(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("cx"), ((b["y0"] + b["y1"]) / 2).alias("cy"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return w * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def iou(a: Column, b: Column, eps: float = 0.0) -> Column:
    i = intersection(a, b)
    return i / F.nullif(area(a) + area(b) - i + eps, F.lit(0.0))


def iou_smoothed(a: Column, b: Column, eps: float = 1e-6) -> Column:
    i = intersection(a, b)
    return (i + eps) / (area(a) + area(b) - i + eps)


def giou(a: Column, b: Column, eps: float = 0.0) -> Column:
    """IoU less the share of the enclosing box that neither box covers."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    hull = (F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"])) * (F.greatest(a["y1"], b["y1"]) - F.least(a["y0"], b["y0"]))
    return i / F.nullif(union + eps, F.lit(0.0)) - (hull - union) / F.nullif(hull + eps, F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def clamp(b: Column, w: Column, h: Column) -> Column:
    zero = F.lit(0.0)
    fit = lambda v, top: F.least(F.greatest(v, zero), top)
    return box(fit(b["x0"], w), fit(b["y0"], h), fit(b["x1"], w), fit(b["y1"], h))


def has_area(b: Column) -> Column:
    return (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])


def shifted(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def flipped(b: Column, w: Column) -> Column:
    return box(w - b["x1"], b["y0"], w - b["x0"], b["y1"])


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def expanded(b: Column, ratio: Column, w: Column, h: Column, least: float = 0.0) -> Column:
    """b grown by ratio around its centre, sides counted with their last pixel and at least `least` long, in whole
    pixels and clipped to the image."""
    wide, high = F.greatest(ratio * (b["x1"] - b["x0"] + 1), F.lit(least)), F.greatest(ratio * (b["y1"] - b["y0"] + 1), F.lit(least))
    cx, cy = (b["x0"] + b["x1"]) * 0.5, (b["y0"] + b["y1"]) * 0.5
    low, high_end = (lambda c, s: F.greatest(F.lit(0).cast("long"), (c - s * 0.5).cast("long"))), (lambda c, s, top: F.least(top.cast("long"), (c + s * 0.5).cast("long")))
    return box(low(cx, wide), low(cy, high), high_end(cx, wide, w), high_end(cy, high, h))


def squared(b: Column, w: Column, h: Column) -> Column:
    """b, in whole pixels, with its shorter side made as long as the other, around its centre, clipped to the image."""
    x0, y0, x1, y1 = (b[c].cast("long") for c in ("x0", "y0", "x1", "y1"))
    cx, cy = F.floor((x0 + x1) / 2), F.floor((y0 + y1) / 2)
    tall, half = y1 - y0 >= x1 - x0, F.floor(F.greatest(y1 - y0, x1 - x0) / 2)
    zero = F.lit(0).cast("long")
    return box(
        F.greatest(zero, F.when(tall, cx - half).otherwise(x0)), F.greatest(zero, F.when(tall, y0).otherwise(cy - half)),
        F.least(w.cast("long"), F.when(tall, cx + half).otherwise(x1)), F.least(h.cast("long"), F.when(tall, y1).otherwise(cy + half)),
    )


def resized(b: Column, w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """b in an image scaled from w x h to to_w x to_h, in whole pixels."""
    fit = lambda v, side, to: F.least((v / side * to).cast("long"), to.cast("long"))
    return box(fit(b["x0"], w, to_w), fit(b["y0"], h, to_h), fit(b["x1"], w, to_w), fit(b["y1"], h, to_h))


def relative(b: Column, outer: Column) -> Column:
    """b from the corner of the box that it lies in."""
    return shifted(b, -outer["x0"], -outer["y0"])


def square_padding(w: Column, h: Column) -> Column:
    """Pixels before and after that make the shorter side as long as the other: a struct (left, right, top, bottom)."""
    gap = F.abs(w - h)
    first, zero = F.floor(gap / 2), F.lit(0).cast("long")
    at = lambda rule, v: F.when(rule, v).otherwise(zero)
    return F.struct(at(h > w, first).alias("left"), at(h > w, gap - first).alias("right"), at(w > h, first).alias("top"), at(w > h, gap - first).alias("bottom"))


def fitting_scale(b: Column, scale: Column, w: Column, h: Column) -> Column:
    """scale, or 0.7 where the box at its place would leave the image."""
    over = (b["x0"] + F.floor((b["x1"] - b["x0"]) * scale) > w) | (b["y0"] + F.floor((b["y1"] - b["y0"]) * scale) > h)
    return F.when(over, 0.7).otherwise(scale)


def headroom_scale(b: Column, w: Column, h: Column) -> Column:
    """1.3 where the image leaves twice the box's size from its corner on, else 0.7: whole times, against 1.5."""
    room = lambda side, low, high: F.floor((side - low) / F.nullif(high - low, F.lit(0.0))) < 1.5
    return F.when(room(w, b["x0"], b["x1"]) | room(h, b["y0"], b["y1"]), 0.7).otherwise(1.3)


def near_crop_edge(b: Column, crop: Column, image: Column, within: float = 20.0) -> Column:
    """Whether a side lies within reach of the crop's side that is no side of the image."""
    out = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        out = out | ((F.abs(b[c] - crop[c]) <= within) & (F.abs(b[c] - image[c]) > within))
    return out


def touches_border(b: Column, w: Column, h: Column, within: float = 2.0) -> Column:
    return (b["x0"] <= within) | (b["y0"] <= within) | (b["x1"] >= w - within) | (b["y1"] >= h - within)


def share_of_frame(b: Column, side: float = 512.0) -> Column:
    return (b["x1"] - b["x0"]) / side * ((b["y1"] - b["y0"]) / side)


def quadrant(b: Column, side: float = 512.0, by_half_size: bool = False) -> Column:
    """(1 or -1, 1 or -1) by where the centre lies; by_half_size: by half the box's own size instead."""
    x, y = ((b["x1"] - b["x0"]) / 2, (b["y1"] - b["y0"]) / 2) if by_half_size else ((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)
    sign = lambda v: F.when(v < side / 2, -1).otherwise(1)
    return F.struct(sign(x).alias("x"), sign(y).alias("y"))


def rle_area(counts: Column) -> Column:
    """Pixels of a mask of runs, the first of which is off."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, c: s + c)


def rle_pixels(counts: Column) -> Column:
    """Positions of the pixels that are on."""
    ends = F.aggregate(counts, F.array().cast("array<long>"), lambda s, c: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("long")) + c)))
    run = lambda e, i: F.when((i % 2 == 1) & (F.get(counts, i) > 0), F.sequence(e - F.get(counts, i), e - 1)).otherwise(F.array().cast("array<long>"))
    return F.flatten(F.transform(ends, run))
