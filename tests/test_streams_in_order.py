"""Streams whose rows come out of order over several micro-batches, against the batch operators."""

import os
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from parkflow.operators import filters, occupancy, tracking
from parkflow.streaming import streams

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def stream(spark, where, batches, schema):
    """A file for each micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(where))
        for f in where.glob("*.parquet"):
            if f.stat().st_mtime > 2_000_000:
                os.utime(f, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(where))


def run(df, where, listener=None):
    spark = df.sparkSession
    with streams.state_store(spark):
        q = df.writeStream.format("parquet").option("path", str(where / "out")).option("checkpointLocation", str(where / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
    return spark.read.schema(df.schema).parquet(str(where / "out")), q


def shuffled(rows, time, spread, size, rng):
    """Rows in batches of `size`, none more than `spread` seconds behind an earlier one."""
    late = sorted(rows, key=lambda r: time(r) + rng.random() * spread)
    return [late[i : i + size] for i in range(0, len(late), size)]


def test_tracks_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = set()
    for v in ("a", "b"):
        for _ in range(30):
            x, y, dx, dy, f0 = rng.randrange(300), rng.randrange(200), rng.randint(-6, 6), rng.randint(-4, 4), rng.choice([rng.randrange(120), 400 + rng.randrange(50)])
            rows |= {(v, f, x + dx * (f - f0), y + dy * (f - f0), 50, 40) for f in range(f0, f0 + rng.randint(3, 25)) if rng.random() < 0.8}
    schema = "video string, ts timestamp, frame_index long, x int, y int, w int, h int"
    own = [(v, at(f / 10), f, *b) for v, f, *b in sorted(rows)] + [(v, at(100), 1000, 0, 0, 5, 5) for v in "ab"]
    df = stream(spark, tmp_path / "in", shuffled(own, lambda r: r[2] / 10, 3.0, 90, rng), schema)
    got, _ = run(streams.stream_tracks(df, "4 seconds", 0.15, 8, 10.0), tmp_path)
    tracked = tracking.track_frames(spark.createDataFrame(own, schema).withColumn("class_id", F.lit(2)), 0.15, 0.8, 10.0)
    want = tracked.filter("frame_index < 1000").groupBy("video", "track_id").agg(F.min("frame_index"), F.max("frame_index"), F.count("*"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 20


def test_numbers_go_on_after_a_silence(spark, tmp_path):
    schema = "video string, ts timestamp, frame_index long, x int, y int, w int, h int"
    batches = [[("a", at(f / 30), f, 10 + f, 0, 50, 50) for f in range(5)], [("a", at(100 + f / 30), 3000 + f, 10 + f, 0, 50, 50) for f in range(4)], [("z", at(300), 9, 0, 0, 9, 9)]]
    got, _ = run(streams.stream_tracks(stream(spark, tmp_path / "in", batches, schema), "1 second"), tmp_path)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 0, 4, 5), ("a", 2, 3000, 3003, 4)]


def test_occupancy_in_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [(s, i, rng.choice([1, -1]), rng.randrange(0, 400)) for s in (1, 2) for i in range(120)]
    events = [(s, at(t), t, i, step) for s, i, step, t in rows]
    schema = "site long, ts timestamp, t long, entity_id long, step int"
    df = stream(spark, tmp_path / "in", shuffled(events, lambda r: r[2], 30, 60, rng) + [[(s, at(1000), 1000, 999, 1) for s in (1, 2)]], schema)
    got, _ = run(streams.stream_occupancy_in_order(df, "60 seconds"), tmp_path)
    timeline = occupancy.running_occupancy(spark.createDataFrame([(s, t, i, step) for s, i, step, t in rows], "site long, t long, entity_id long, step int"))
    want = sorted((r.site, r.t, r.entity_id, r.entered_total, r.exited_total, r.entered_total - r.exited_total) for r in timeline.collect())
    assert sorted(tuple(r)[:6] for r in got.collect()) == want
    assert {r.site: r.least for r in got.groupBy("site").agg(F.min("least").alias("least")).collect()} == {r.site: min(0, r.low) for r in timeline.groupBy("site").agg(F.min(F.col("entered_total") - F.col("exited_total")).alias("low")).collect()}


def test_adaptive_skip_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(v, i, rng.randrange(3)) for v in "ab" for i in range(150)]
    frames = [(v, at(i / 10), i, n) for v, i, n in rows]
    schema = "video string, ts timestamp, frame_index long, detections long"
    df = stream(spark, tmp_path / "in", shuffled(frames, lambda r: r[2] / 10, 2, 70, rng) + [[(v, at(99), 990, 1) for v in "ab"]], schema)
    got, _ = run(streams.stream_adaptive_skip_in_order(df, 2, 3, "3 seconds"), tmp_path)
    want = filters.adaptive_downsample(spark.createDataFrame(rows, "video string, frame_index long, detections long"), 2, 3)
    assert sorted(map(tuple, got.collect())) == sorted((r.video, r.frame_index) for r in want.collect())


def test_late_rows_are_counted_as_they_come(spark, tmp_path):
    schema = "site long, ts timestamp, t long, entity_id long, step int"
    event = lambda t, i: (1, at(t), t, i, 1)
    batches = [[event(0, 1), event(100, 2)], [event(200, 3)], [event(50, 4), event(210, 5)], [event(1, 6), event(2, 7), event(900, 8)]]
    listener = streams.LateRows()
    spark.streams.addListener(listener)
    try:
        got, q = run(streams.stream_occupancy_in_order(stream(spark, tmp_path / "in", batches, schema), "10 seconds"), tmp_path)
        counts = listener.table(spark, str(q.runId))
    finally:
        spark.streams.removeListener(listener)
    assert counts.agg(F.sum("dropped")).first()[0] == 3 == streams.late_rows(q.recentProgress)
    assert sorted(r.entity_id for r in got.collect()) == [1, 2, 3, 5]
    assert [r.dropped for r in counts.filter("dropped > 0").orderBy("batch").collect()] == [1, 2]
