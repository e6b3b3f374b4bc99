"""Queries over views larger than the given tables, and rules that hold however dense a table is."""

import random

import pytest
from pyspark.sql import functions as F

from parkflow.operators import catalog, graph, plates, tracking
from parkflow.plans.queries import QUERIES, _crossings
from tests.test_matching import plain_catalog
from tests.test_queries import plain_tracks


def test_every_saved_crossing_is_read_again(spark, tmp_path):
    """More crossings than one document holds."""
    i = F.col("id")
    events = spark.range(3600).select(i.alias("event_id"), F.timestamp_seconds(1_704_067_200 + i * 1000).alias("ts"), (i % 1200).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["e_reloaded_accuracy"](spark, str(tmp_path)).collect()
    want = plates.dwell_accuracy(_crossings(spark, str(tmp_path)), 1_500_000, 0.02).collect()
    assert sorted(got) == sorted(want) and sum(r.n for r in got) > 1000


def test_claims_in_a_dense_recording(spark):
    """Many cars and tracks at each time, some recordings; parts of a few cars, so that claims reach over their borders."""
    rng = random.Random(3)
    cars = [(r, i, rng.randrange(60) / 10) for r in "ab" for i in range(150)] + [("c", 0, 1.0), ("a", 999, None)]
    tracks = [(r, i, rng.randrange(60) / 10) for r in "ab" for i in range(130)] + [("d", 0, 1.0)]
    want, used = set(), set()
    for r, car, t in sorted((c for c in cars if c[2] is not None), key=lambda c: (c[0], c[2], c[1])):
        near = sorted((abs(u - t), k) for q, k, u in tracks if q == r and t - 0.5 <= u <= t + 0.5 and (q, k) not in used)
        if near:
            used.add((r, near[0][1]))
            want.add((r, car, near[0][1]))
    for each in (7, 1000):
        got = tracking.nearest_time_match(spark.createDataFrame(cars, "recording string, car_id long, t double"), spark.createDataFrame(tracks, "recording string, track_id long, t double"), 0.5, each).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("each", [40, 400])
def test_tracks_over_the_borders_of_parts(spark, each):
    """Crowds in which many boxes are alike, in parts of a few frames."""
    rng = random.Random(each)
    rows = set()
    for _ in range(50):
        x, y, dx, f0 = 10 * rng.randrange(20), 10 * rng.randrange(12), rng.randint(-6, 6), rng.randrange(90)
        rows |= {(f, x + dx * (f - f0), y, 40, 30) for f in range(f0, f0 + rng.randint(3, 40)) if rng.random() < 0.8}
    rows = sorted(rows)
    df = spark.createDataFrame([(i, "v", *r) for i, r in enumerate(rows)], "id long, video string, frame_index long, x long, y long, w long, h long")
    got = {r.id: r.chain for r in tracking.followed(df, "video", "frame_index", 4, 0.15, each=each).collect()}
    want = plain_tracks(rows, 0.15, 4)
    firsts = {want[r]: i for i, r in reversed(list(enumerate(rows)))}
    assert got == {i: firsts[want[r]] for i, r in enumerate(rows)}


def test_catalog_over_the_borders_of_parts(spark):
    rng = random.Random(2)
    times = {i: 20 * i for i in range(25)}
    rows = [(i, 1000 * i + k, rng.randrange(2), rng.randrange(0, 300, 10), rng.randrange(0, 200, 10), 60, 40) for i in times for k in range(12)]
    df = spark.createDataFrame([(n, r[2], times[r[0]], *r[3:]) for n, r in enumerate(rows)], "id long, type_id int, epoch_s long, x long, y long, w long, h long")
    got = {rows[r.id][:2]: rows[r.chain][1] for r in tracking.followed(df, "type_id", "epoch_s", 25.0, 0.0, strict=True, in_turn=True, each=30).collect()}
    assert got == plain_catalog(rows, times, 25.0)


def test_candidates_of_equal_boxes_are_counted_not_listed(spark):
    rows = [("v", f, 5 * f, 10 * k, 40, 30, 2) for f in range(4) for k in range(2) for _ in range(3)]
    df = spark.createDataFrame(rows, "video string, frame_index long, x long, y long, w long, h long, class_id int")
    got = {r.time: (r.n, r.iou) for r in tracking.iou_by_frame(df, 2).collect()}
    numbers = df.withColumn("id", F.monotonically_increasing_id())
    pairs = tracking.iou_candidates(numbers, 2).groupBy("time").agg(F.count("*").alias("n"), F.sum("iou").alias("iou")).collect()
    assert got == {r.time: (r.n, pytest.approx(r.iou)) for r in pairs} and got[3][0] == 72


def test_mates_of_a_large_cluster_are_many_tasks(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(60)], "entity_id long, cluster long")
    for compat in (False, True):
        found = catalog.cluster_mates(df, compat, block=8)
        want = {(i, k) for i in range(60) for k in range(60) if i != k and (i % 5 == 0) == (k % 5 == 0) and (i % 5 == 0 and compat or i % 5 and i % 2 == k % 2)}
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
        assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4
    asked = catalog.cluster_mates(df, of=spark.createDataFrame([(1,)], "entity_id long"), block=8).collect()
    assert {r.mate_id for r in asked} == {k for k in range(3, 60, 2) if k % 5}


def test_groups_of_boxes_without_a_table_of_pairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(m, 100 * m + (i * 37) % 90, rng.randrange(900), rng.randrange(600), rng.randrange(70), rng.randrange(5, 90)) for m in range(3) for i in range(90)]
    df = spark.createDataFrame(rows, "image_id long, idx long, x long, y long, w long, h long")
    pairs = [tuple(r)[1:] for r in graph.close_pairs(df, 20, 1.5).collect()]
    want = {r[1]: r[1] for r in rows}
    while (after := want | {i: min(want[i], *[want[k] for p in pairs if i in p for k in p]) for p in pairs for i in p}) != want:
        want = after
    monkeypatch.setattr(graph, "close_pairs", None)
    got = graph.box_clusters(df, 20, 1.5).collect()
    assert {r.idx: r.cluster for r in got} == want and len(got) == len(rows) and 9 < len(set(want.values())) < 250
