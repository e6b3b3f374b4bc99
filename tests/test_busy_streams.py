"""Busy videos as streams: boxes go through by frames, and meet by place."""

import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from parkflow.operators.tracking import met
from parkflow.streaming import streams


def plain(live, own, least):
    found = set()
    for i, p in enumerate(own):
        for k, q in enumerate(live):
            both = max(0, min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0])) * max(0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]))
            union = p[2] * p[3] + q[2] * q[3] - both
            if both > 0 and union > 0 and (least == 0 or both / union >= least):
                found.add((i, k, both / union))
    return found


@pytest.mark.parametrize("least", [0.0, 0.15])
@pytest.mark.parametrize(("size", "scale"), [(2, 1), (30, 1), (30, 0.37), (200, 1)])
def test_boxes_that_meet_are_those_of_all_pairs(least, size, scale):
    rng = np.random.default_rng(size)
    for n, m in ((0, 5), (5, 0), (40, 40), (1, 60)):
        live, own = (np.column_stack([rng.integers(-60, 60, k), rng.integers(-60, 60, k), rng.integers(-1, size, k), rng.integers(-1, size, k)]) * float(scale) for k in (n, m))
        found = list(zip(*met(live, own, least, most=50)))
        assert len(set(found)) == len(found) and set(found) == plain(live, own, least)


def test_boxes_one_above_the_other_are_not_all_compared():
    live = np.column_stack([np.zeros(40_000), 20.0 * np.arange(40_000), np.full(40_000, 9.0), np.full(40_000, 9.0)])
    began = time.process_time()
    i, k, iou = met(live, live[::8], 0.15)
    assert (iou == 1).all() and len(i) == 5_000 and (k == 8 * i).all()
    assert time.process_time() - began < 2  # 200 million pairs otherwise


@pytest.mark.parametrize("most", [7, 1000])
def test_boxes_of_a_frame_go_through_together(spark, most):
    rng, start = random.Random(most), datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [(rng.choice(["a", "b", None]), start + timedelta(seconds=f) if f else None, f, rng.random(), 2.0, 3.0, rng.choice([4.0, None])) for f in (rng.randrange(5) for _ in range(200))]
    df = spark.createDataFrame(rows, "video string, ts timestamp, frame_index long, x double, y double, w double, h double").coalesce(1)
    got = df.mapInArrow(streams._framed(most), "video string, ts timestamp, frame_index long, boxes binary").withColumn("us", F.unix_micros("ts")).collect()
    boxes = lambda r: [(r.video, r.us, r.frame_index, *("null" if np.isnan(v) else v for v in b)) for b in np.frombuffer(r.boxes).reshape(-1, 4).tolist()]
    want = [("null" if v is None else v for v in r) for r in df.select("video", F.unix_micros("ts"), "frame_index", *"xywh").collect()]
    assert sorted(map(str, (b for r in got for b in boxes(r)))) == sorted(str((*(None if v == "null" else v for v in r[:3]), *r[3:])) for r in map(tuple, want))
    assert most == 7 or len(got) == len({r[:3] for r in rows})


def test_documents_are_compressed_and_whole(spark, tmp_path):
    from parkflow.plans import exchange
    from parkflow.sources import readers

    rows = spark.range(3000).select(F.lit("v.mp4").alias("video"), (F.col("id") % 300).cast("int").alias("frame_index"), *[F.lit(8.0).alias(c) for c in "xywh"])
    one = F.struct("frame_index", exchange._box().alias("box"), F.lit(2).alias("class_id"), F.lit("car").alias("label"), F.lit(0.5).alias("confidence"))
    where = exchange._documents(rows, exchange._by_key("video", one, "detections"), F.floor(F.col("frame_index") / 100))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where).select("path", "length").collect()
    assert len(files) == 3 and sum(f.length for f in files) < 100_000  # about 300,000 bytes of text
    assert readers.read_video_detections(spark, where).groupBy("frame_index").count().filter("count = 10").count() == 300
