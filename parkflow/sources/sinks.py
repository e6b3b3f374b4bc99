"""CSV, JSON and Parquet outputs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkflow.tables import task, written


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def _stamp(seconds) -> list:
    t = F.timestamp_seconds(seconds)
    return [F.date_format(t, "yyyy-MM-dd").alias("date"), F.date_format(t, "HH:mm:ss").alias("time")]


def write_interval_counts(counts: DataFrame, path: str) -> None:
    """Rows of counts_per_interval or counts_per_image with date and time."""
    write_csv(counts.orderBy("bucket").select(*_stamp(F.col("bucket")), *[F.col(f"`{c}`") for c in counts.columns if c != "bucket"]), path)


write_image_counts = write_interval_counts


def write_entities(rollup: DataFrame, path: str) -> None:
    write_csv(rollup, path)


def write_clusters(rollup: DataFrame, path: str) -> None:
    write_csv(rollup, path)


def write_occupancy(timeline: DataFrame, path: str) -> None:
    """timestamp, iso time, event, entered, exited and occupancy; t in microseconds."""
    at = F.timestamp_micros("t")
    event = F.when(F.col("step") > 0, "entry").otherwise("exit")
    write_csv(timeline.select("site", (F.col("t") / 1e6).alias("timestamp"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), event.alias("event"), F.col("entered_total").alias("entered"), F.col("exited_total").alias("exited"), "occupancy"), path)


def write_report(path: str, metadata: dict[str, str], statistics: DataFrame, rows: DataFrame, name: str) -> None:
    """One JSON document with metadata and statistics (one row), and the rows as JSON lines beside it."""
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])
    statistics.select(meta.alias("metadata"), F.struct(*statistics.columns).alias("statistics")).write.json(f"{path}/report")
    rows.write.json(f"{path}/{name}")


def listed_lines(batches: Iterator[pa.RecordBatch], under: str) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows of a key and an object (JSON text), the rows of a key together, as one document
    {under: {key: [object, ...], ...}} a task, cut at its closing braces, which are left out. Rows go through as they come,
    so a document may have any size."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, begun = batch[0], last is not None
        fresh = np.append(not begun or keys[0].as_py() != last, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
        ahead = np.full(batch.num_rows, ",", object)
        for i in np.flatnonzero(fresh):
            ahead[i] = ("]," if begun or i else f"{{{json.dumps(under)}: {{") + f"{json.dumps(keys[int(i)].as_py())}: ["
        last = keys[-1].as_py()
        ones = pc.ascii_rtrim_whitespace(batch[1])
        if not pc.all(pc.fill_null(pc.ends_with(ones, "}"), False)).as_py():
            raise ValueError("not an object of JSON")
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.array(ahead, pa.string()), pc.binary_slice(ones.cast("binary"), 0, -1).cast("string"), "")], ["value"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(["]", ""])], ["value"])


def write_listed(df: DataFrame, path: str, under: str, each: int | None = None) -> None:
    """df(key, object as JSON text), the rows of a key together in their task, as a report for each task.

    It is one file compressed by bzip2, whose blocks are read on their own. each: files of so many objects that follow one
    another by their names (read by `listed_objects` with `rolled`), compressed by gzip, which costs far less than bzip2,
    above all where objects repeat."""
    lines = df.mapInArrow(task(__name__, "listed_lines", under=under), "value string").write.option("lineSep", "}")
    lines = lines.option("compression", "bzip2") if each is None else lines.option("compression", "gzip").option("maxRecordsPerFile", each)
    lines.text(path)


def write_gallery(profiles: DataFrame, path: str) -> None:
    """Profiles by entity, vectors included."""
    profiles.write.partitionBy("camera").parquet(path)


def write_by(df: DataFrame, path: str, by: str) -> None:
    """Laid out by a column, each value's rows together."""
    df.repartition(by).write.partitionBy(by).parquet(path)


def replace_partitions(spark: SparkSession, path: str, by: str, done: DataFrame, new: DataFrame, key: str) -> None:
    """Replace, in a table laid out by a column, the rows whose key is in done(key, by) by `new`. Only the partitions that
    done and new name are read and written again, each as a whole; the others' files stay as they are."""
    kept = spark.read.parquet(path)
    touched = done.select(by).unionByName(new.select(by)).distinct()
    rows = kept.join(F.broadcast(touched) if touched.count() <= 10_000 else touched, by, "left_semi").join(done.select(key).distinct(), key, "left_anti")
    every = written(rows.unionByName(new, allowMissingColumns=True))  # what is overwritten below is read no more
    every.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_by_camera_day(images: DataFrame, path: str) -> None:
    """Laid out by camera and date, so that reads of some days skip the others."""
    images.withColumn("date", F.to_date(F.timestamp_seconds("epoch_s"))).repartition("camera", "date").write.partitionBy("camera", "date").parquet(path)
