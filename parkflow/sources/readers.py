"""Reports, ground truth, manifests, histograms and media listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkflow.functions.clock import parse_clock_text
from parkflow.functions.geometry import box_from_corners
from parkflow.sources.long_json import listed_objects
from parkflow.tables import numbered

VIDEO_DETECTION = "frame_index int, box array<double>, class_id int, label string, confidence double"
ENTITY = "video string, entity_id int, direction string, entity_type int, relative_speed double, absolute_speed double"
MANIFEST = "timestamp double, confidence double, source_video string, frame_index int"
IMAGES, VIDEOS = ("jpg", "jpeg", "png"), ("mp4", "avi", "mov", "mkv", "webm")
CATALOG = {
    "image": "image_id long, path string, epoch_s long, analyzed boolean",
    "video": "video_id long, path string, epoch_s long, analyzed boolean, frames long, fps double",
    "entity": "entity_id long, cluster long, speed double, raw_speed double, ebike boolean",
    "instance": "image_id long, entity_id long, type_id int, x int, y int, width int, height int, confidence double, direction_lr int, direction_fb int",
}


def _json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)


def _fields(columns: str) -> str:
    """Columns as the fields of a struct."""
    return ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", "))


def _cornered(df: DataFrame, d: str = "d") -> list:
    b = F.col(f"{d}.box")
    box = box_from_corners(*[F.get(b, F.lit(i)) for i in range(4)])
    return [c.alias(n) for c, n in zip(box, "xywh")]


def _listed(spark: SparkSession, paths: str | list[str], fields: str, key: str, in_parts: bool, rolled: bool = False) -> DataFrame:
    """The key and each d (a struct of fields) of {"detections": {key: [d, ...], ...}}."""
    if in_parts or rolled:
        found = listed_objects(spark, paths, "detections", rolled, most=128)
        return found.select(F.col("key").alias(key), F.explode(F.from_json("value", f"array<struct<{_fields(fields)}>>", {"mode": "FAILFAST"})).alias("d"))
    df = _json(spark, paths, f"detections map<string, array<struct<{_fields(fields)}>>>")
    return df.select(F.explode("detections").alias(key, "list")).select(key, F.explode("list").alias("d"))


def read_video_detections(spark: SparkSession, path: str | list[str], in_parts: bool = False, rolled: bool = False) -> DataFrame:
    """video, frame_index, x, y, w, h, class_id, label, confidence from {"detections": {video: [...]}}.

    in_parts: a file is read by many tasks, as a long report needs (see listed_objects); else each file is one task's.
    rolled: a report is several files, which are read so too.
    """
    rows = _listed(spark, path, VIDEO_DETECTION, "video", in_parts, rolled)
    return rows.select("video", "d.frame_index", *_cornered(rows), "d.class_id", "d.label", "d.confidence")


def read_image_detections(spark: SparkSession, path: str | list[str], in_parts: bool = False) -> DataFrame:
    """image, x, y, w, h, class_id, confidence; the label of a still's detection is the number of its class. in_parts: as
    for videos."""
    rows = _listed(spark, path, "box array<double>, label string, confidence double", "image", in_parts)
    return rows.select("image", *_cornered(rows), F.col("d.label").try_cast("int").alias("class_id"), "d.confidence")


def read_entity_report(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """report and the rows of its individual_entities; a report without any is an error."""
    df = _json(spark, paths, f"individual_entities array<struct<{_fields(ENTITY)}>>").select(F.input_file_name().alias("report"), "individual_entities")
    some = F.coalesce(F.size("individual_entities"), F.lit(0)) > 0
    checked = F.when(some, F.col("individual_entities")).otherwise(F.raise_error(F.concat(F.lit("no entities in "), "report")).cast(df.schema["individual_entities"].dataType))
    return df.select("report", F.inline(checked))


def read_direction_histograms(spark: SparkSession, path: str) -> DataFrame:
    """row, label, direction, bin, n from a wide CSV: date, direction, then a column for each bin."""
    df = spark.read.option("header", True).csv(path)
    if len(df.columns) < 3 or [c.strip().lower() for c in df.columns[:2]] != ["date", "direction"]:
        raise ValueError("the header must be date, direction and at least one bin")
    numbered = df.withColumn("row", F.monotonically_increasing_id()).withColumnsRenamed({df.columns[0]: "label", df.columns[1]: "direction"})
    long = numbered.unpivot(["row", "label", "direction"], df.columns[2:], "bin", "n")
    return long.select("row", "label", "direction", F.col("bin").cast("double").alias("bin"), F.col("n").cast("double").alias("n"))


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def _map(spark: SparkSession, path: str, value: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("path", "v"))


def read_plate_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, timestamp, confidence, source_video, frame_index; empty when the file is missing or can't be read."""
    try:
        return _map(spark, path, f"struct<{_fields(MANIFEST)}>").select("path", "v.*")
    except Exception as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], f"path string, {MANIFEST}")


def read_plate_ground_truth(spark: SparkSession, path: str, usable_only: bool = False) -> DataFrame:
    """path and truth: a text, empty where unreadable, null where nobody has looked."""
    df = _map(spark, path, "string").withColumnRenamed("v", "truth")
    return df.filter("truth is not null and truth <> ''") if usable_only else df


def read_start_times(spark: SparkSession, path: str, as_of_year: int = 2026) -> DataFrame:
    """pos and epoch_s from a JSON array of epoch seconds or ISO times; anything else is an error."""
    text = spark.read.option("wholetext", True).text(path)
    items = F.from_json("value", "array<string>")
    whole = F.when(F.trim("value").startswith("["), items).otherwise(F.raise_error(F.lit("start times must be an array")).cast("array<string>"))
    df = text.select(F.posexplode(whole).alias("pos", "item"))
    iso = F.unix_timestamp(F.try_to_timestamp("item")).cast("double")
    value = F.coalesce(F.col("item").try_cast("double"), iso, parse_clock_text(F.col("item"), as_of_year)["seconds"])
    return df.select("pos", F.coalesce(value, F.raise_error(F.concat(F.lit("not a start time: "), F.coalesce("item", F.lit("null")))).cast("double")).alias("epoch_s"))


def check_start_times(times: DataFrame | None, videos: DataFrame) -> None:
    """None are fine, else there must be one for each video."""
    if times is not None and (n := times.count()) and n != (m := videos.count()):
        raise ValueError(f"{n} start times for {m} videos")


def attach_start_times(videos: DataFrame, times: DataFrame) -> DataFrame:
    """The i-th time to the i-th video by path."""
    return numbered(videos, ["video"]).join(times, "pos", "left").drop("pos")


def attach_detections(videos: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of each video by relative path; videos without any keep a row of nulls."""
    return videos.join(detections, "video", "left")


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """type, rect and points of the zones in a labels file."""
    zone = "array<struct<type: string, rect: array<double>, points: array<array<double>>>>"
    return _json(spark, path, f"__zones__ {zone}").select(F.explode("__zones__").alias("z")).select("z.*")


def catalog_media(spark: SparkSession, folder: str, kind: str = "image", extra: tuple[str, ...] = ()) -> DataFrame:
    """path, modified and length of the media files below a folder; contents aren't read."""
    endings = "|".join((*(IMAGES if kind == "image" else VIDEOS), *extra))
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    return df.filter(F.lower("path").rlike(rf"\.({endings})$"))


def read_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables of a catalogue."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in CATALOG.items()}


def gt_cars(recordings: DataFrame) -> DataFrame:
    """car_id, valid, speed and first and last crossing of rows with an intersections array."""
    at = lambda i: F.element_at("intersections", i)["time"]
    return recordings.select("recording", "car_id", "valid", "speed", at(1).alias("first_crossing"), at(-1).alias("last_crossing"))


def reload_crossings(spark: SparkSession, path: str) -> DataFrame:
    """Crossings of a saved benchmark report."""
    crossing = "array<struct<truth: string, sightings: bigint, clusters: bigint, status: string, true_dwell: double, ocr_dwell: double>>"
    return _json(spark, path, f"crossings {crossing}").select(F.inline("crossings"))


def records_to_paths(profiles: DataFrame, listing: DataFrame) -> DataFrame:
    """Profiles(img_name) with the first path of that file name."""
    named = listing.groupBy(F.element_at(F.split("path", "/"), -1).alias("img_name")).agg(F.min("path").alias("path"))
    return profiles.join(named, "img_name", "left")


def score_batches(df: DataFrame, load, score, schema: str) -> DataFrame:
    """A user's model over batches: load() once for each partition, score(model, pandas frame) for each batch."""

    def run(batches):
        model = load()
        for batch in batches:
            yield score(model, batch)

    return df.mapInPandas(run, schema)
