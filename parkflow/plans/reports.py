"""Whole analyses, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkflow.functions.vectors import normalize_plate
from parkflow.operators import occupancy, plates, tracking
from parkflow.tables import written


def run_plate_dwell(readings: list[DataFrame], manifest: DataFrame | None = None, k: int = 0, gap: float | None = None, least_dwell: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Matches, and the headline counters, of pooled readings(img_path, plate_text, t)."""
    rows = plates.pool_directories(*readings).withColumn("plate_text", normalize_plate(F.col("plate_text")))
    rows = rows if manifest is None else plates.attach_manifest(rows, manifest)
    matches = plates.plate_dwell(rows, k, gap, least_dwell)
    return matches, plates.dwell_report_stats(rows, matches).crossJoin(F.broadcast(plates.average_dwell(matches)))


def run_plate_dwell_benchmark(readings: DataFrame, k: int, least_dwell: float) -> tuple[DataFrame, DataFrame]:
    """Crossings of true plates against groups of readings(img_path, truth, plate_text, t), and their summary."""
    groups = readings.join(plates.fuzzy_groups(readings, k), "plate_text")
    ocr = groups.groupBy("plate_group").agg((F.max("t") - F.min("t")).alias("dwell"))
    crossings = plates.classify_crossings(readings.select("img_path", "truth", "t"), groups, ocr)
    return crossings, plates.crossing_status_summary(crossings, least_dwell)


def run_profile(profiles: DataFrame, **options) -> DataFrame:
    """The sightings of each camera's entities, a row each: camera, entity_id, t, profile_id, and of the entity sightings,
    first_t and last_t."""
    found = written(tracking.reidentify(profiles, **options).drop("feature"))
    whole = found.groupBy("camera", "entity_id").agg(F.count("*").alias("sightings"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return found.join(whole, ["camera", "entity_id"])


def run_occupancy(entry: DataFrame, exit_: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Timeline and statistics of sites with profiles(camera, profile_id, t, feature) on both sides. Where one camera
    sees both, the exit's features must come from mirrored pictures."""
    sides = [tracking.reidentify(df, **options).select(F.col("camera").alias("site"), F.lit(side).alias("side"), "entity_id", "t") for df, side in ((entry, "entry"), (exit_, "exit"))]
    timeline = occupancy.running_occupancy(occupancy.entry_exit_events(sides[0].unionByName(sides[1])))
    return timeline, occupancy.occupancy_stats(timeline)
