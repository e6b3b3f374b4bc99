"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from parkflow.operators import catalog, occupancy
from parkflow.sources import readers, sinks
from parkflow.streaming import streams


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_detection_reports(spark, tmp_path):
    path = put(tmp_path / "v.json", {"detections": {"a.mp4": [{"frame_index": 3, "box": [10.9, 20, 30, 60.5], "class_id": 2, "label": "car", "confidence": 0.5}], "b.mp4": []}})
    rows = readers.read_video_detections(spark, path).collect()
    assert [tuple(r) for r in rows] == [("a.mp4", 3, 10, 20, 20, 40, 2, "car", 0.5)]
    path = put(tmp_path / "i.json", {"detections": {"a.jpg": [{"box": [1, 2, 3, 5], "label": "7", "confidence": 0.25}]}})
    assert [tuple(r) for r in readers.read_image_detections(spark, path).collect()] == [("a.jpg", 1, 2, 2, 3, 7, 0.25)]


def test_entity_reports(spark, tmp_path):
    row = {"video": "a", "entity_id": 1, "direction": "left", "entity_type": None, "relative_speed": 0.5}
    path = put(tmp_path / "r.json", {"individual_entities": [row]})
    assert readers.read_entity_report(spark, path).select("entity_id", "absolute_speed").first() == (1, None)
    with pytest.raises(Exception, match="no entities"):
        readers.read_entity_report(spark, put(tmp_path / "e.json", {"individual_entities": []})).collect()


def test_histograms(spark, tmp_path):
    (tmp_path / "h.csv").write_text("date,direction,10,20\n2026-01-01,left,1,2\n2026-01-02,left,3,4\n")
    rows = readers.read_direction_histograms(spark, str(tmp_path / "h.csv")).orderBy("label", "bin").collect()
    assert [(r.label, r.bin, r.n) for r in rows] == [("2026-01-01", 10, 1), ("2026-01-01", 20, 2), ("2026-01-02", 10, 3), ("2026-01-02", 20, 4)]
    (tmp_path / "bad.csv").write_text("day,x\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_direction_histograms(spark, str(tmp_path / "bad.csv"))


def test_plates_and_times(spark, tmp_path):
    path = put(tmp_path / "m.json", {"a.jpg": {"timestamp": 1.5, "confidence": 0.5, "source_video": "v.mp4", "frame_index": 2}})
    assert readers.read_plate_manifest(spark, path).first().asDict() == {"path": "a.jpg", "timestamp": 1.5, "confidence": 0.5, "source_video": "v.mp4", "frame_index": 2}
    assert readers.read_plate_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "broken.json").write_text("{nothing")
    assert readers.read_plate_manifest(spark, str(tmp_path / "broken.json")).count() == 0
    path = put(tmp_path / "g.json", {"a": "X1", "b": "", "c": None})
    assert {r.path: r.truth for r in readers.read_plate_ground_truth(spark, path).collect()} == {"a": "X1", "b": "", "c": None}
    assert readers.read_plate_ground_truth(spark, path, usable_only=True).count() == 1
    times = readers.read_start_times(spark, put(tmp_path / "t.json", [100.5, "1970-01-01T00:01:00"]))
    assert [tuple(r) for r in times.orderBy("pos").collect()] == [(0, 100.5), (1, 60.0)]
    videos = spark.createDataFrame([("b",), ("a",)], "video string")
    assert {r.video: r.epoch_s for r in readers.attach_start_times(videos, times).collect()} == {"a": 100.5, "b": 60.0}
    readers.check_start_times(times, videos)
    with pytest.raises(ValueError):
        readers.check_start_times(times, videos.limit(1))
    with pytest.raises(Exception, match="not a start time"):
        readers.read_start_times(spark, put(tmp_path / "u.json", ["soon"])).collect()
    zones = readers.read_zones(spark, put(tmp_path / "z.json", {"__zones__": [{"type": "include", "rect": [0, 0, 1, 1]}, {"type": "exclude", "points": [[0, 0], [1, 1]]}]}))
    assert [r.type for r in zones.collect()] == ["include", "exclude"]


def test_media_listing(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("a.JPG", "x/b.png", "c.mp4", "d.txt"):
        (tmp_path / name).write_bytes(b"1")
    listing = readers.catalog_media(spark, str(tmp_path))
    assert listing.count() == 2 and readers.catalog_media(spark, str(tmp_path), "video").count() == 1
    profiles = spark.createDataFrame([("b.png",), ("z.png",)], "img_name string")
    assert {r.img_name: r.path is not None for r in readers.records_to_paths(profiles, listing).collect()} == {"b.png": True, "z.png": False}


def test_score_batches(spark):
    out = readers.score_batches(spark.range(5), lambda: 2, lambda m, b: b.assign(id=b["id"] * m), "id long")
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]


def test_writers(spark, tmp_path):
    images = spark.createDataFrame([(1, 0, "c"), (2, 90000, "c")], "image_id long, epoch_s long, camera string")
    sinks.write_by_camera_day(images, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).filter("date = '1970-01-02'").count() == 1
    instances = spark.createDataFrame([(1, 7, 0, None, None)], "image_id long, entity_id long, type_id int, direction_lr int, direction_fb int")
    counts = catalog.counts_per_image(images, instances, spark.createDataFrame([(7, 1)], "entity_id long, cluster long"), {0: "person"})
    sinks.write_interval_counts(counts, str(tmp_path / "counts"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "counts")).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [("1970-01-01", "00:00:00", "1", "1"), ("1970-01-02", "01:00:00", "0", "0")]
    seen = spark.createDataFrame([(1, "entry", 5, 10), (1, "exit", 6, 20)], "site long, side string, entity_id long, t long")
    timeline = occupancy.running_occupancy(occupancy.entry_exit_events(seen))
    sinks.write_occupancy(timeline, str(tmp_path / "occupancy"))
    assert spark.read.option("header", True).csv(str(tmp_path / "occupancy")).count() == 2
    sinks.write_report(str(tmp_path / "report"), {"tool": "x"}, occupancy.occupancy_stats(timeline), timeline, "rows")
    assert spark.read.json(str(tmp_path / "report/report")).first().statistics.max_occupancy == 1
    profiles = spark.createDataFrame([("c", 1, [0.5])], "camera string, entity_id long, feature array<float>")
    sinks.write_gallery(profiles, str(tmp_path / "gallery"))
    assert spark.read.parquet(str(tmp_path / "gallery")).count() == 1


def run(df, mode, path):
    name = f"t{abs(hash(str(path)))}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_stream_new_media(spark, tmp_path):
    df = stream(spark, tmp_path, [("a",), ("b",), ("a",)], "path string")
    assert run(streams.stream_new_media(df), "append", tmp_path / "c").count() == 2


def test_stream_new_media_forgets_behind_the_watermark(spark, tmp_path):
    import os
    from datetime import datetime, timedelta

    t, schema = datetime(2026, 1, 1), "path string, modified timestamp"
    for i, rows in enumerate(([("a", t), ("a", t)], [("b", t + timedelta(days=3))], [("b", t + timedelta(days=3)), ("c", t + timedelta(days=4))], [("a", t), ("c", t + timedelta(days=4))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if f.stat().st_mtime > 2_000_000:
                os.utime(f, (1_000_000 + i, 1_000_000 + i))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_new_media(df, "1 day").writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.path for r in spark.table("fresh").collect()) == ["a", "b", "c"]
    assert streams.late_rows(q.recentProgress) == 1


def test_stream_dwell(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    rows = [("A", t), ("A", t + timedelta(seconds=10)), ("A", t + timedelta(seconds=25)), ("B", t + timedelta(days=1))]
    df = stream(spark, tmp_path, rows, "plate_text string, ts timestamp")
    got = run(streams.stream_dwell(df, "10 seconds", "1 second"), "append", tmp_path / "c").collect()
    assert sorted((r.plate_text, r.sightings) for r in got if r.plate_text == "A") == [("A", 1), ("A", 2)]


def test_stream_interval_counts(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    rows = [(1, 0, t), (1, 0, t + timedelta(minutes=1)), (2, 0, t), (3, 2, t), (9, 0, t + timedelta(days=2))]
    df = stream(spark, tmp_path, rows, "entity_id long, type_id int, ts timestamp")
    got = run(streams.stream_interval_counts(df, "10 minutes", "1 minute"), "append", tmp_path / "c").filter("start = '2026-01-01'").collect()
    assert sorted((r.type_id, r.n) for r in got) == [(0, 2), (2, 1)]


def test_stream_occupancy_and_skip(spark, tmp_path):
    df = stream(spark, tmp_path, [(1, 10, 5, 1), (1, 20, 6, -1), (1, 30, 7, -1), (2, 5, 1, 1)], "site long, t long, entity_id long, step int")
    got = run(streams.stream_occupancy(df), "append", tmp_path / "c").orderBy("site", "t").collect()
    assert [(r.running, r.least) for r in got] == [(1, 0), (0, 0), (-1, -1), (1, 0)]
    (tmp_path / "s").mkdir()
    df = stream(spark, tmp_path / "s", [("a", i, 0 if i == 4 else 1) for i in range(0, 20)], "video string, frame_index long, detections long")
    got = run(streams.stream_adaptive_skip(df, 2, 3), "append", tmp_path / "d").orderBy("frame_index").collect()
    assert [r.frame_index for r in got] == [0, 2, 4, 12, 14, 16, 18]


def test_stream_tracks(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    rows = [("a", t + timedelta(seconds=i), i, 10 + i, 0, 50, 50) for i in range(5)] + [("a", t + timedelta(seconds=300), 300, 0, 0, 9, 9)]
    df = stream(spark, tmp_path, rows, "video string, ts timestamp, frame_index long, x int, y int, w int, h int")
    got = run(streams.stream_tracks(df, "1 second"), "append", tmp_path / "c").orderBy("track_id").collect()
    assert tuple(got[0]) == ("a", 1, 0, 4, 5)
