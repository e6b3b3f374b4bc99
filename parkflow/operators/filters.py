"""Predicates on detections, images and entities, and how they combine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkflow.functions import clock, labels
from parkflow.functions.geometry import Box, box, box_intersects
from parkflow.tables import written

DAY = 86400


def keep_confident(df: DataFrame, least: float = labels.DEFAULT_CONFIDENCE) -> DataFrame:
    return df.filter(F.col("confidence") >= least)


def keep_classes(df: DataFrame, ids=labels.DEFAULT_CLASSES) -> DataFrame:
    return df.filter(F.col("class_id").isin(*ids))


def keep_region(df: DataFrame, region: Box) -> DataFrame:
    return df.filter(box_intersects(box(), region))


def downsample_frames(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.pmod("frame_index", F.lit(n)) == 0)


def adaptive_downsample(frames: DataFrame, n: int, skip: int) -> DataFrame:
    """Every n-th frame of each video, but after one without detections the next `skip` of them are left out.

    frames: video, frame_index, detections (a count). The rule runs in frame order within each video.

    How many frames are still to be left out is the state of a small automaton. A stretch of frames maps each state that
    it may begin with to the one that it ends with; these maps are composed up a tree over a video's stretches, and the
    states with which the stretches begin follow down the tree. So no task or row holds more than a stretch of a video.
    """
    sampled = downsample_frames(frames, n).groupBy("video", F.floor(F.col("frame_index") / (n * STRETCH)).alias("part"))
    parts = sampled.agg(F.array_sort(F.collect_list(F.struct("frame_index", "detections"))).alias("own"))
    first = sampled.agg(F.lit(0)).groupBy("video").agg(F.min("part").alias("first_part"))
    parts = written(parts.join(first, "video").withColumn("part", F.col("part") - F.col("first_part")).drop("first_part"))
    after = lambda left, empty: F.when(left > 0, left - 1).otherwise(F.when(empty, skip).otherwise(0))
    ends = F.transform(F.sequence(F.lit(0), F.lit(skip)), lambda s: F.aggregate("own", s, lambda left, f: after(left, f["detections"] == 0)))
    begins = _begin_states(parts.select("video", "part", ends.alias("ends")))
    first = F.struct(F.col("state").alias("left"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, f: Column) -> Column:
        kept = F.when(acc["left"] > 0, acc["kept"]).otherwise(F.array_append(acc["kept"], f["frame_index"].cast("long")))
        return F.struct(after(acc["left"], f["detections"] == 0).alias("left"), kept.alias("kept"))

    return parts.join(begins, ["video", "part"]).select("video", F.explode(F.aggregate("own", first, step)["kept"]).alias("frame_index"))


STRETCH = 256


def _begin_states(maps: DataFrame) -> DataFrame:
    """video, part and the state with which each part begins, for maps(video, part, ends: by the state at its start);
    the first part of a video begins with 0."""
    grouped = maps.groupBy("video", F.floor(F.col("part") / STRETCH).alias("above")).agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("own"))
    grouped = written(grouped)
    if grouped.groupBy("video").count().filter("count > 1").isEmpty():
        above = grouped.select("video", "above", F.lit(0).alias("state"))
    else:
        states = F.sequence(F.lit(0), F.size(F.col("own")[0]["ends"]) - 1)
        ends = F.transform(states, lambda s: F.aggregate("own", s, lambda x, m: F.get(m["ends"], x)))
        above = _begin_states(grouped.select("video", F.col("above").alias("part"), ends.alias("ends"))).withColumnRenamed("part", "above")
    first = F.struct(F.col("state"), F.array().cast("array<struct<part: bigint, state: int>>").alias("found"))
    step = lambda acc, m: F.struct(F.get(m["ends"], acc["state"]).alias("state"), F.array_append(acc["found"], F.struct(m["part"].alias("part"), acc["state"].alias("state"))).alias("found"))
    return grouped.join(above, ["video", "above"]).select("video", F.inline(F.aggregate("own", first, step)["found"]))


def drop_degenerate_boxes(df: DataFrame) -> DataFrame:
    return df.filter("w > 0 and h > 0")


def images_analyzed(images: DataFrame, yes: bool = True) -> DataFrame:
    return images.filter(F.col("analyzed") == yes).select("image_id")


def images_in_time(images: DataFrame, low: int, high: int) -> DataFrame:
    """By seconds of the day, both ends included; no wrap at midnight."""
    return images.filter(clock.time_of_day(F.col("epoch_s")).between(low, high)).select("image_id")


def images_in_dates(images: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """From the start of the first day to the end of the last (epoch seconds of midnight)."""
    return images.filter(F.col("epoch_s").between(first_day, last_day + DAY - 1)).select("image_id")


def images_with_entities(images: DataFrame, instances: DataFrame, type_id: int | None, confidence: float, low: int | None = None, high: int | None = None) -> DataFrame:
    """Images with confident instances (of a type); with bounds, only those with so many."""
    own = instances.filter(F.col("confidence") >= confidence)
    own = own if type_id is None else own.filter(F.col("type_id") == type_id)
    n = own.groupBy("image_id").agg(F.count("*").alias("n"))
    n = n if low is None else n.filter(F.col("n").between(low, high))
    return images.join(n, "image_id", "left_semi").select("image_id")


def images_without(images: DataFrame, instances: DataFrame, type_id: int, most: float) -> DataFrame:
    """Images whose surest instance of the type is no surer than `most`."""
    top = instances.filter(F.col("type_id") == type_id).groupBy("image_id").agg(F.max("confidence").alias("top"))
    return images.join(top, "image_id", "left").filter(F.coalesce("top", F.lit(0.0)) <= most).select("image_id")


def images_by_cluster_count(instances: DataFrame, entities: DataFrame, low: int, high: int) -> DataFrame:
    n = instances.join(entities.select("entity_id", "cluster"), "entity_id").groupBy("image_id").agg(F.count_distinct("cluster").alias("n"))
    return n.filter(F.col("n").between(low, high)).select("image_id")


def _seen(instances: DataFrame, images: DataFrame) -> DataFrame:
    return instances.join(images.select("image_id", "epoch_s"), "image_id")


def entities_in_dates(instances: DataFrame, images: DataFrame, first_day: int, last_day: int, compat: bool = False) -> DataFrame:
    """Seen at least once in the days. compat: the last day counts to its first moment only."""
    end = last_day if compat else last_day + DAY - 1
    return _seen(instances, images).filter(F.col("epoch_s").between(first_day, end)).select("entity_id").distinct()


def entities_in_time(instances: DataFrame, images: DataFrame, low: int, high: int) -> DataFrame:
    return _seen(instances, images).filter(clock.time_of_day(F.col("epoch_s")).between(low, high)).select("entity_id").distinct()


def entities_of_type(instances: DataFrame, type_id: int) -> DataFrame:
    return instances.filter(F.col("type_id") == type_id).select("entity_id").distinct()


def entities_by_cluster_size(entities: DataFrame, low: int, high: int) -> DataFrame:
    sizes = entities.filter("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n").between(low, high))
    return entities.join(sizes, "cluster", "left_semi").select("entity_id")


def entities_by_sightings(instances: DataFrame, confidence: float, low: int | None = None, high: int | None = None) -> DataFrame:
    n = instances.filter(F.col("confidence") >= confidence).groupBy("entity_id").agg(F.count("*").alias("n"))
    return (n if low is None else n.filter(F.col("n").between(low, high))).select("entity_id")


def entities_by_direction(instances: DataFrame, word: str) -> DataFrame:
    """left, right, forward, back, or unknown (0 in either; null isn't unknown)."""
    lr, fb = F.col("direction_lr"), F.col("direction_fb")
    test = {"left": lr == -1, "right": lr == 1, "forward": fb == 1, "back": fb == -1, "unknown": (lr == 0) | (fb == 0)}[word]
    return instances.filter(test).select("entity_id").distinct()


def entities_by_speed(entities: DataFrame, low: float, high: float, speed: str = "speed") -> DataFrame:
    return entities.filter(F.col(speed).between(low, high)).select("entity_id")


def report_scope(entities: DataFrame, entity_type: int | None = None, direction: str | None = None) -> DataFrame:
    df = entities if entity_type is None else entities.filter(F.col("entity_type") == entity_type)
    return df if direction is None else df.filter(F.lower("direction") == direction.lower())


def images_for_profiling(paths: DataFrame, categories: list[str], direction: str = "UNKNOWN") -> DataFrame:
    """Picture files whose stem ends with a category, and whose name says the direction asked for."""
    path = F.col("path")
    named = reduce(lambda a, b: a | b, [F.lower(labels.stem(path)).endswith(c.lower()) for c in categories])
    way = F.lit(True) if direction == "UNKNOWN" else labels.direction_from_name(path) == direction
    return paths.filter(F.lower(labels.suffix(path)).isin(".jpg", ".jpeg", ".png", ".bmp") & named & way)


def usable_plates(truths: DataFrame) -> DataFrame:
    """Readable and finished ones: neither null nor empty."""
    return truths.filter("truth is not null and truth <> ''")


def any_of(*ids: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), ids).distinct()


def all_of(*ids: DataFrame) -> DataFrame:
    """Each filter is met on its own; different instances may meet different ones."""
    return reduce(lambda a, b: a.intersect(b), ids)


def filter_expression(rows: list[list[DataFrame]]) -> DataFrame:
    """Any of the rows, all of a row's filters."""
    return any_of(*[all_of(*row) for row in rows])


def same_members(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def all_groups(key: str, *counters: DataFrame) -> DataFrame:
    return any_of(*[c.select(key) for c in counters])
