"""Boxes as column expressions. A box is four columns: x, y, w, h."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column


def box(prefix: str = "", w: str = "w", h: str = "h") -> Box:
    return Box(*(F.col(prefix + c) for c in ("x", "y", w, h)))


def box_from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    """Corners truncated to whole pixels."""
    a, b, c, d = (v.cast("int") for v in (x1, y1, x2, y2))
    return Box(a, b, c - a, d - b)


def box_area(b: Box, clamp: bool = False) -> Column:
    """Area; clamped sides can't be negative."""
    return F.greatest(F.lit(0), b.w) * F.greatest(F.lit(0), b.h) if clamp else b.w * b.h


def box_center(b: Box) -> tuple[Column, Column]:
    return b.x + b.w / 2, b.y + b.h / 2


def box_center_int(b: Box) -> tuple[Column, Column]:
    half = lambda v: F.floor(v / 2).cast("long")
    return b.x + half(b.w), b.y + half(b.h)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def box_iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union isn't positive."""
    both = intersection(a, b)
    union = a.w * a.h + b.w * b.h - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def box_intersects(a: Box, b: Box) -> Column:
    """Strict overlap: boxes that only touch don't intersect."""
    return (a.x < b.x + b.w) & (b.x < a.x + a.w) & (a.y < b.y + b.h) & (b.y < a.y + a.h)


def zone_to_pixels(zone: Column, width: Column, height: Column) -> Box:
    """A zone struct (rect: array x, y, w, h; or points: array of arrays x, y) of shares of the frame, in pixels."""
    xs, ys = F.transform(zone["points"], lambda p: p[0]), F.transform(zone["points"], lambda p: p[1])
    rect = [zone["rect"][i] for i in range(4)]
    hull = [F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)]
    scale = (width, height, width, height)
    return Box(*((F.when(zone["rect"].isNotNull(), r).otherwise(p) * s).cast("int") for r, p, s in zip(rect, hull, scale)))


def excluded_by_zones(b: Box, zones: Column) -> Column:
    """Whether the box hits a zone of type exclude, or hits no include zone although there are some.

    zones: array of structs (type, x, y, w, h) in pixels."""
    hits = lambda z: box_intersects(b, Box(z["x"], z["y"], z["w"], z["h"]))
    shut = F.exists(zones, lambda z: (z["type"] == "exclude") & hits(z))
    fenced = F.exists(zones, lambda z: z["type"] == "include")
    inside = F.exists(zones, lambda z: (z["type"] == "include") & hits(z))
    return shut | (fenced & ~inside)


def margin_region(width: Column, height: Column, percent: Column) -> Box:
    """The centre rectangle that leaves `percent` of each side free, truncated."""
    x, y = (width * percent / 100).cast("int"), (height * percent / 100).cast("int")
    return Box(x, y, (width * (100 - 2 * percent) / 100).cast("int"), (height * (100 - 2 * percent) / 100).cast("int"))


def aspect_ratio(b: Box) -> Column:
    return F.when(b.h > 0, b.w / b.h)


def boxes_close(a: Box, b: Box, distance: int, compat: bool = False) -> Column:
    """Whether the boxes overlap or touch once one is grown by `distance`. compat: the lower edge is taken as y + y."""
    low = (lambda r: r.y + r.y) if compat else (lambda r: r.y + r.h)
    d = distance
    return (a.x <= b.x + b.w + d) & (b.x <= a.x + a.w + d) & (a.y <= low(b) + d) & (b.y <= low(a) + d)


def similar_size(a: Box, b: Box, ratio: float) -> Column:
    """Whether the larger area is at most `ratio` times the smaller one; never where one isn't positive."""
    p, q = a.w * a.h, b.w * b.h
    return (p > 0) & (q > 0) & (F.greatest(p, q) <= ratio * F.least(p, q))


def pad_box(b: Box, share: float, width: Column, height: Column) -> Box:
    """Grown by a share of each side on each side, within the frame."""
    px, py = (b.w * share).cast("int"), (b.h * share).cast("int")
    x, y = F.greatest(F.lit(0), b.x - px), F.greatest(F.lit(0), b.y - py)
    return Box(x, y, F.least(width, b.x + b.w + px) - x, F.least(height, b.y + b.h + py) - y)


def center_box(width: Column, height: Column, margin: float) -> Box:
    """What stays after a share of each side is trimmed all round; everything if nothing would."""
    mx, my = (width * margin).cast("int"), (height * margin).cast("int")
    ok = (width - 2 * mx > 0) & (height - 2 * my > 0)
    pick = lambda inner, whole: F.when(ok, inner).otherwise(whole)
    return Box(pick(mx, F.lit(0)), pick(my, F.lit(0)), pick(width - 2 * mx, width), pick(height - 2 * my, height))


def union_box(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.x + a.w, b.x + b.w) - x, F.greatest(a.y + a.h, b.y + b.h) - y)


def union_box_agg(b: Box) -> list[Column]:
    """The same as aggregates over a group: x, y, w, h."""
    x, y = F.min(b.x), F.min(b.y)
    return [x.alias("x"), y.alias("y"), (F.max(b.x + b.w) - x).alias("w"), (F.max(b.y + b.h) - y).alias("h")]


def quality_score(b: Box, sharpness: Column) -> Column:
    return b.w * b.h * sharpness


def motion_direction(first: Box, last: Box, tie: str = "right", anchor: str = "center") -> Column:
    """left or right by where a track's last box stands against its first. tie: what no motion counts as; anchor:
    compare centres, or left edges."""
    a, b = (first.x, last.x) if anchor == "left" else (box_center(first)[0], box_center(last)[0])
    return F.when(b >= a if tie == "right" else b > a, F.lit("right")).otherwise(F.lit("left"))


def pixel_speed(first: Box, last: Box, seconds: Column, horizontal: bool = False) -> Column:
    """Pixels a second between centres; 0 where no time has passed. horizontal: whole-pixel centres, x only."""
    if horizontal:
        way = F.abs(box_center_int(last)[0] - box_center_int(first)[0])
    else:
        (ax, ay), (bx, by) = box_center(first), box_center(last)
        way = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    return F.when(seconds > 0, way / F.when(seconds > 0, seconds)).otherwise(F.lit(0.0))
