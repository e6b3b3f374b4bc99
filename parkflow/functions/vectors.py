"""Plates, vectors, bins and poses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_plate(s: Column, least: int = 3) -> Column:
    """Upper case, letters and digits only; null when too short."""
    t = F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")
    return F.when(F.length(t) >= least, t)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def within_edits(a: Column, b: Column, k: int) -> Column:
    return F.levenshtein(a, b, k) >= 0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def l2_normalize(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    norm = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors: the dot product."""
    return _dot(a, b)


def color_similarity(a: Column, b: Column) -> Column:
    """1 minus the Bhattacharyya distance of two histograms."""
    root = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    both = F.sqrt(_sum(a) * _sum(b))
    return 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - F.when(both > 0, root / F.when(both > 0, both)).otherwise(0.0)))


def fused_similarity(cos: Column, color: Column, aspect_gap: Column, same_image: Column, close_in_time: Column, unnamed: Column) -> Column:
    """Appearance and colour, damped by the difference of shape; -1 within one image (where an image has no name:
    within a tenth of a second). color and aspect_gap may be null."""
    s = F.when(color.isNotNull(), 0.7 * cos + 0.3 * color).otherwise(cos)
    s = F.when(aspect_gap.isNotNull(), s * (0.8 + 0.2 * F.exp(-4 * aspect_gap))).otherwise(s)
    return F.when(F.coalesce(same_image, F.lit(False)) | (unnamed & close_in_time), F.lit(-1.0)).otherwise(s)


def minmax_scale(v: Column, low: float, high: float, a: Column, b: Column) -> Column:
    """Linear from [a, b], the least and the largest value, to [low, high]; constant input goes to the middle."""
    return F.when(b > a, low + (v - a) / F.when(b > a, b - a) * (high - low)).otherwise(F.lit((low + high) / 2))


def nearest_bin(v: Column, bins: list[float]) -> Column:
    """Label of the nearest bin, the first given one if tied; null outside the bins' range."""
    each = F.array(*[F.struct(F.abs(v - b).alias("d"), F.lit(i).alias("i"), F.lit(b).alias("bin")) for i, b in enumerate(bins)])
    return F.when(v.between(min(bins), max(bins)), F.array_min(each)["bin"])


#: The public COCO numbering of key points, by side of the body; and those of a car, by end.
LEFT, RIGHT, FRONT, BACK = (1, 3, 5, 7, 9, 11, 13, 15), (2, 4, 6, 8, 10, 12, 14, 16), (1, 2, 3, 9, 10), (5, 6, 11, 12)
CAR_FRONT, CAR_REAR = (0, 1, 4, 5, 9, 10), (2, 3, 6, 7, 11, 12)


def _mean_x(points: Column, which: tuple[int, ...], least: float, positive: bool) -> tuple[Column, Column]:
    own = F.filter(points, lambda p: p["i"].isin(*which) & (p["conf"] >= least) & ((p["x"] > 0) & (p["y"] > 0) if positive else F.lit(True)))
    n = F.size(own)
    total = F.aggregate(F.transform(own, lambda p: p["x"].cast("double")), F.lit(0.0), lambda s, x: s + x)
    return n, total / F.greatest(n, F.lit(1))


def pose_direction(points: Column, least_conf: float = 0.5, least_points: int = 2) -> dict[str, Column]:
    """left_right and front_back (-1, 0, 1) and a label from key points (array of struct i, x, y, conf)."""
    def way(a: tuple[int, ...], b: tuple[int, ...]) -> Column:
        (n, x), (m, y) = _mean_x(points, a, least_conf, True), _mean_x(points, b, least_conf, True)
        return F.when((x == y) | (n < least_points) | (m < least_points), 0).when(x < y, -1).otherwise(1)

    lr, fb = way(FRONT, BACK), way(LEFT, RIGHT)
    label = F.when(lr == 1, "right").when(lr == -1, "left").when(fb == 1, "front").when(fb == -1, "back").otherwise("unknown")
    return {"left_right": lr, "front_back": fb, "label": label}


def vehicle_pose_direction(points: Column, least_conf: float = 0.5, least_points: int = 2) -> dict[str, Column]:
    """Which way a car faces, from the mean x of its front and its rear, and the share of its points that were sure."""
    (n, front), (m, rear) = _mean_x(points, CAR_FRONT, least_conf, False), _mean_x(points, CAR_REAR, least_conf, False)
    label = F.when((n < least_points) | (m < least_points) | (front == rear), "unknown").when(front > rear, "right").otherwise("left")
    return {"label": label, "confidence": (n + m) / 12}
