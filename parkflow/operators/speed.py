"""Speeds: tracks' summaries, calibration against one known speed, and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkflow.functions.geometry import Box, motion_direction, pixel_speed
from parkflow.functions.labels import class_label, relative_error_bucket
from parkflow.operators.filters import report_scope
from parkflow.tables import exact_quantiles, numbered


def majority_type(detections: DataFrame, *keys: str) -> DataFrame:
    """The class that most of a track's boxes have, the first seen if tied."""
    votes = detections.groupBy(*keys, "class_id").agg(F.count("*").alias("n"), F.min("frame_index").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "class_id"))
    return votes.groupBy(*keys).agg(best["class_id"].alias("entity_type"))


def first_last_box(detections: DataFrame, *keys: str) -> DataFrame:
    box = F.struct("frame_index", "x", "y", "w", "h")
    return detections.groupBy(*keys).agg(F.min(box).alias("first"), F.max(box).alias("last"), F.count("*").alias("boxes"))


def best_per_group(df: DataFrame, keys: list[str], quality: Column, order: Column) -> DataFrame:
    """The row of the highest quality in each group, the earliest if tied."""
    w = Window.partitionBy(*keys).orderBy(quality.desc(), order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def track_entities(tracked: DataFrame, fps: float) -> DataFrame:
    """A row for each track of detections(video, track_id, frame_index, x, y, w, h, class_id): type, first and last
    frame, direction and speed in pixels a second."""
    ends = first_last_box(tracked, "video", "track_id").join(majority_type(tracked, "video", "track_id"), ["video", "track_id"])
    a, b = (Box(*(F.col(f"{s}.{c}") for c in "xywh")) for s in ("first", "last"))
    seconds = (F.col("last.frame_index") - F.col("first.frame_index")) / fps
    return ends.select("video", F.col("track_id").alias("entity_id"), "entity_type", F.col("first.frame_index").alias("first_frame"), F.col("last.frame_index").alias("last_frame"), "boxes", motion_direction(a, b).alias("direction"), pixel_speed(a, b, seconds).alias("raw_speed"))


def track_stats(entities: DataFrame) -> DataFrame:
    """How many videos and entities there are, and how many of these go left and right."""
    way = F.lower("direction")
    return entities.agg(F.count_distinct("video").alias("videos"), F.count("*").alias("entities"), F.count_if(way == "left").alias("n_left"), F.count_if(way == "right").alias("n_right"))


def relative_speed(entities: DataFrame, raw: str = "raw_speed") -> DataFrame:
    """Speed as a share of the fastest; 0 where none moves."""
    top = entities.agg(F.max(raw).alias("__top"))
    share = F.when(F.col("__top") > 0, F.col(raw) / F.when(F.col("__top") > 0, F.col("__top"))).otherwise(F.lit(0.0))
    return entities.crossJoin(F.broadcast(top)).withColumn("relative_speed", share).drop("__top")


def reference_scale(entities: DataFrame, entity_id: int | Column, speed: float, video: str | None = None) -> DataFrame:
    """scale, as one row, from the one entity whose speed is known. Errors say what is wrong with it."""
    own = entities.filter(F.col("entity_id") == entity_id)
    named = own if video is None else own.filter(F.col("video") == video)
    found = named.agg(F.count("*").alias("n"), F.max("relative_speed").alias("relative"))
    where = own.agg(F.array_join(F.array_sort(F.collect_set("video")), ", ").alias("videos"))
    fault = F.when((F.col("n") == 0) & (F.col("videos") != ""), F.concat(F.lit("the reference is in other videos: "), "videos")).when(F.col("n") == 0, "the reference isn't there").when(F.col("n") > 1, "the reference is ambiguous; name its video").when(~(F.col("relative") > 0), "the reference doesn't move")
    return found.crossJoin(where).select(F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(speed / F.when(F.col("relative") > 0, F.col("relative"))).alias("scale"))


def calibrate_speed(entities: DataFrame, entity_id: int | Column, speed: float, video: str | None = None, entity_type: int | None = None, direction: str | None = None) -> DataFrame:
    """entities(video, entity_id, direction, entity_type, relative_speed, absolute_speed) with absolute speeds where
    type and direction are those asked for; others keep theirs."""
    scope = report_scope(entities, entity_type, direction)
    scale = reference_scale(scope, entity_id, speed, video)
    inside = F.lit(True)
    if entity_type is not None:
        inside = inside & F.col("entity_type").eqNullSafe(F.lit(entity_type))
    if direction is not None:
        inside = inside & F.lower("direction").eqNullSafe(F.lit(direction.lower()))
    return entities.crossJoin(F.broadcast(scale)).withColumn("absolute_speed", F.when(inside, F.col("relative_speed") * F.col("scale")).otherwise(F.col("absolute_speed"))).drop("scale")


def _summary(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, means and medians of each group; medians by rank over a range sort, both speeds in one."""
    way = F.lower("direction")
    counts = entities.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("video").alias("videos"), F.count_if(way == "left").alias("n_left"), F.count_if(way == "right").alias("n_right"), F.count("absolute_speed").alias("n_calibrated"), F.avg("relative_speed").alias("mean_relative"), F.avg("absolute_speed").alias("mean_absolute"))
    both = entities.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(f"{c}_speed").alias("speed")) for c in ("relative", "absolute")])).alias("x")).select(*keys, "x.*")
    middle = exact_quantiles(both, [*keys, "which"], "speed", {"median": 0.5})
    middle = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == c, F.col("median"))).alias(f"median_{c}") for c in ("relative", "absolute")])
    return counts.join(middle, keys, "left") if keys else counts.join(middle, how="left")


def summarize_every(entities: DataFrame) -> DataFrame:
    """The summaries of the whole report, of each type and of each video, as kind and label, from one pass over the
    entities: each is expanded into the groups that it belongs to, as grouping sets do."""
    labels = {"all": F.lit("all"), "type": class_label(F.col("entity_type"), report=True), "video": F.coalesce("video", F.lit("unknown"))}
    groups = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("label")) for k, v in labels.items()])
    rows = entities.select("video", "direction", "relative_speed", "absolute_speed", F.explode(groups).alias("g"))
    return _summary(rows.select("*", "g.*").drop("g"), ["kind", "label"])


def summarize_report(entities: DataFrame) -> DataFrame:
    return _summary(entities, [])


def summarize_by_type(entities: DataFrame) -> DataFrame:
    return _summary(entities.withColumn("label", class_label(F.col("entity_type"), report=True)), ["label"])


def summarize_by_video(entities: DataFrame) -> DataFrame:
    return _summary(entities.withColumn("label", F.coalesce("video", F.lit("unknown"))), ["label"])


def labels_to_reports(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """reports(report) in order of path with labels(pos, label), else `Report n`."""
    return numbered(reports, ["report"]).join(labels, "pos", "left").select("report", F.coalesce("label", F.concat(F.lit("Report "), (F.col("pos") + 1).cast("string"))).alias("label"))


def speed_accuracy(pairs: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Errors of pairs(speed_kmh, estimate)."""
    e = F.abs(F.col("estimate") - F.col("speed_kmh"))
    rel = F.when(F.col("speed_kmh") > 0, e / F.when(F.col("speed_kmh") > 0, F.col("speed_kmh")))
    buckets = [F.count_if(relative_error_bucket(rel) == b).alias(f"n_{i}") for i, b in enumerate(("<=5%", "<=20%", "<=50%", ">50%"))]
    middle = exact_quantiles(pairs.select(e.alias("e")), [], "e", {"median_abs": 0.5})
    return pairs.agg(F.count("*").alias("n"), F.avg(e).alias("mean_abs"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(rel).alias("mean_relative"), F.avg((rel <= tolerance).cast("double")).alias("reasonable"), *buckets).join(middle, how="left")
