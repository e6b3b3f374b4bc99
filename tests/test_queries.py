"""Every registered query of the detection analytics against its SQL, and rules that SQL can't state."""

import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from parkflow.functions import clock, geometry, labels, vectors
from parkflow.functions.geometry import Box
from parkflow.operators import filters, graph, plates, scoring, speed, tracking
from parkflow.plans.queries import ORACLE_SQL, QUERIES, _image_boxes
from parkflow.tables import numbered

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else float(f"{float(v):.9g}") if abs(v) >= 1e3 else round(float(v), 6)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


def plain_tracks(rows, least, alive):
    live, out, following = [], {}, 1
    for frame in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == frame]
        live = [t for t in live if frame - t[1] <= alive]

        def iou(a, b):
            w, h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
            both = max(0, w) * max(0, h)
            return both / (a[3] * a[4] + b[3] * b[4] - both)

        pairs = sorted((-iou(r, t[2]), i, k) for i, r in enumerate(own) for k, t in enumerate(live) if iou(r, t[2]) >= least)
        used_i, used_k = set(), set()
        for _, i, k in pairs:
            if i not in used_i and k not in used_k:
                used_i.add(i), used_k.add(k)
                live[k][1:] = [frame, own[i]]
                out[own[i]] = live[k][0]
        for i, r in enumerate(own):
            if i not in used_i:
                live.append([following, frame, r])
                out[r] = following
                following += 1
    return out


def test_tracking(spark):
    rows = sorted({(f, 10 + 5 * f + 200 * k, 20, 40 + k, 40) for f in [*range(5), 7, 30, 31, 200, 201] for k in range(3)})
    df = spark.createDataFrame([("v", *r, 2) for r in rows], "video string, frame_index long, x long, y long, w long, h long, class_id int")
    got = {(r.frame_index, r.x, r.y, r.w, r.h): r.track_id for r in tracking.track_frames(df, 0.15, 2.0, 10.0).collect()}
    assert got == plain_tracks(rows, 0.15, 20)
    entities = speed.track_entities(df.withColumn("track_id", F.floor(F.col("w") - 40)), 10.0).collect()
    assert all(e.raw_speed == pytest.approx(50.0) and e.direction == "right" for e in entities)


def test_catalog_tracking(spark):
    images = spark.createDataFrame([(i, t) for i, t in enumerate([0, 1, 2, 50, 51])], "image_id long, epoch_s long")
    rows = [(0, 10, 0, 0), (1, 11, 0, 5), (2, 12, 0, 10), (3, 13, 0, 12), (4, 14, 0, 14), (1, 20, 2, 5)]
    df = spark.createDataFrame([(i, e, t, x, 0, 20, 20) for i, e, t, x in rows], "image_id long, entity_id long, type_id int, x long, y long, width long, height long")
    tracked = tracking.track_catalog(df, images, 2.0)
    assert {r.entity_id: r.new_id for r in tracked.collect()} == {10: 10, 11: 10, 12: 10, 13: 13, 14: 13, 20: 20}
    motion = {r.entity_id: (r.raw_speed, r.direction_lr) for r in tracking.track_motion(tracked).collect()}
    assert motion == {10: (5.0, 1), 13: (2.0, 1), 20: (0.0, None)}
    assert {r.entity_id: r.n for r in tracking.track_motion(tracked, compat=True).collect()} == {10: 2, 13: 1}


def test_reidentification(spark):
    rows = [("c", 1, 0.0, [1.0, 0.0]), ("c", 2, 5.0, [0.99, 0.05]), ("c", 3, 6.0, [0.0, 1.0]), ("c", 4, 21.0, [1.0, 0.0]), ("d", 5, 0.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "camera string, profile_id long, t double, feature array<double>")
    ids = lambda gap: {r.profile_id: r.entity_id for r in tracking.reidentify(df, max_gap=gap).collect()}
    assert ids(None) == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    assert ids(10.0) == {1: 1, 2: 1, 3: 2, 4: 3, 5: 1}


def test_reidentification_against_a_plain_fold(spark):
    rng = random.Random(6)
    kinds = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(c, i, float(3 * i + rng.randint(0, 40) * (i % 9 == 0)), [x + rng.gauss(0, 0.3) for x in kinds[rng.randrange(5)]]) for c in ("a", "b") for i in range(c == "b", 70)]
    df = spark.createDataFrame(rows, "camera string, profile_id long, t double, feature array<double>")
    for gap in (None, 30.0):
        want = {}
        for c in ("a", "b"):
            seen, n = [], 0
            for _, i, t, v in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
                best = {}
                for k, s, u in seen:
                    if gap is None or s >= t - gap:
                        cosine = sum(x * y for x, y in zip(u, v)) / math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
                        best[k] = max(best.get(k, -1.0), cosine)
                order = sorted(best.items(), key=lambda x: (-x[1], x[0]))
                ok = bool(order) and order[0][1] >= 0.75 and (len(order) < 2 or max(1 - order[0][1], 1e-6) / max(1 - order[1][1], 1e-6) <= 0.8)
                n += not ok
                want[c, i] = order[0][0] if ok else n
                seen.append((want[c, i], t, v))
        assert {(r.camera, r.profile_id): r.entity_id for r in tracking.reidentify(df, max_gap=gap).collect()} == want


def test_similarity_without_a_gap_in_blocks(spark):
    rng = random.Random(1)
    d = [(i % 2, i, rng.random()) for i in range(40)]
    g = [(i % 2, i % 7, rng.random()) for i in range(60)]
    df, gf = spark.createDataFrame(d, "d_camera long, d_id long, d_v double"), spark.createDataFrame(g, "g_camera long, g_entity long, g_v double")
    want = {}
    for c, i, v in d:
        for k, e, u in g:
            if c == k:
                want[i, e] = max(want.get((i, e), -9.0), v * u)
    for block in (4096, 7):
        got = tracking.similarity_candidates(df, gf, F.col("d_v") * F.col("g_v"), block=block).collect()
        assert {(r.d_id, r.g_entity): r.similarity for r in got} == want and len(got) == len(want)


def test_numbered(spark):
    df = spark.createDataFrame([(x % 37, x) for x in range(500)], "a long, b long").repartition(7)
    assert [(r.a, r.b) for r in sorted(numbered(df, ["a", "b"]).collect(), key=lambda r: r.pos)] == sorted((x % 37, x) for x in range(500))
    rows = sorted(numbered(df, [F.col("a").desc(), "b"], "n", ("b", "a")).collect(), key=lambda r: r.n)
    assert all((q.before_a, q.before_b) == (p.before_a + p.a, p.before_b + p.b) for p, q in zip(rows, rows[1:])) and rows[0].before_b == 0
    assert sorted(r.pos for r in numbered(df, ["a"]).collect()) == list(range(500)) and numbered(df.limit(0), ["a"]).collect() == []


def test_nearest_match(spark):
    cars = spark.createDataFrame([("r", 1, 10.0), ("r", 2, 10.2), ("r", 3, 50.0)], "recording string, car_id long, t double")
    tracks = spark.createDataFrame([("r", 7, 10.1), ("r", 8, 10.4), ("r", 9, 49.0)], "recording string, track_id long, t double")
    assert {r.car_id: r.track_id for r in tracking.nearest_time_match(cars, tracks, 0.5).collect()} == {1: 7, 2: 8}


def test_speed_benchmark_figures(spark):
    pairs = spark.createDataFrame([(100.0, 100.0 + e) for e in (1, 5, 10, 20)], "speed_kmh double, estimate double")
    r = speed.speed_accuracy(pairs).first()
    assert (r.mean_abs, r.median_abs, round(r.rmse, 3), r["n_0"], r["n_1"]) == (9.0, 7.5, 11.467, 2, 2)


def test_calibration_faults(spark):
    rows = [("a", 1, "left", 2, 0.5, None), ("b", 1, "left", 2, 1.0, None), ("b", 2, "right", 2, 0.0, None)]
    df = spark.createDataFrame(rows, "video string, entity_id long, direction string, entity_type int, relative_speed double, absolute_speed double")
    got = {(r.video, r.entity_id): r.absolute_speed for r in speed.calibrate_speed(df, 1, 60.0, video="a", direction="LEFT").collect()}
    assert got == {("a", 1): 60.0, ("b", 1): 120.0, ("b", 2): None}
    for kwargs, fault in (({}, "ambiguous"), ({"video": "c"}, "other videos: a, b"), ({"entity_id": 2}, "doesn't move"), ({"entity_id": 5}, "isn't there")):
        with pytest.raises(Exception, match=fault):
            speed.calibrate_speed(df, **({"entity_id": 1, "speed": 60.0} | kwargs)).collect()


def test_label_counts_refuse_other_labels(spark):
    df = spark.createDataFrame([("left", "up")], "truth string, predicted string")
    with pytest.raises(Exception, match="unexpected label"):
        scoring.label_counts(df, ["left"]).collect()


def test_fuzzy_plates(spark):
    texts = ["381KE4", "381KE9", "38IKE4", "ZZZ", "ZZ", "381E4"]
    df = spark.createDataFrame([(t,) for t in texts], "plate_text string")
    want = {tuple(sorted((a, b))) for a in texts for b in texts if a != b and duckdb.sql(f"select levenshtein('{a}','{b}')").fetchall()[0][0] <= 2}
    assert {(r.plate_text, r.other) for r in plates.fuzzy_plate_pairs(df, 2).collect()} == want
    rows = [("381KE4", 0.0, "a"), ("381KE9", 4000.0, "b"), ("38IKE4", 11949.89, "c")]
    r = plates.plate_dwell(spark.createDataFrame(rows, "plate_text string, t double, img_path string"), 1).collect()
    assert [(x.plate_text, x.dwell, x.sightings, x.variants) for x in r] == [("381KE4", 11949.89, 3, "381KE4,381KE9,38IKE4")]


def test_dwell_with_a_gap_of_all_readings(spark, tmp_path):
    at = lambda i: 1_704_067_200 + 9_000 * i + 150_000 * (i // 25)
    rows = [(i, at(i), i * i % 7) for i in range(1, 120)]
    events = spark.createDataFrame([(i, t, u) for i, t, u in rows], "event_id long, s long, user_id long")
    events.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id").write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    for i, t, u in rows:
        truth = f"{(u * 7919 + 13) % 999983:06d}"
        if i % 23:
            seen.append((truth if i % 17 else truth[:5] + "X", t))
    near = {(a, b): duckdb.sql(f"select levenshtein('{a}','{b}')").fetchall()[0][0] <= 1 for a in {p for p, _ in seen} for b in {p for p, _ in seen}}
    group = list(range(len(seen)))
    for i, (a, s) in enumerate(seen):
        for j, (b, t) in enumerate(seen[:i]):
            if near[a, b] and abs(s - t) <= 200_000 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    times = [[t for (_, t), h in zip(seen, group) if h == g] for g in sorted(set(group))]
    want = sorted((float(min(t)), float(max(t)), len(t)) for t in times if len(t) >= 2)
    assert len(want) > 10
    assert sorted(tuple(r) for r in QUERIES["e_plate_dwell_gap_all"](spark, str(tmp_path)).collect()) == want


def test_whole_tables_hold_what_subsets_leave_out(spark):
    rows = lambda name: {tuple(r) for r in QUERIES[name](spark, DATA).collect()}
    assert {r for r in rows("c_entities") if r[0] in ("left", "unknown")} == rows("c_entities_direction")
    assert any(d % 10 for d, *_ in rows("g_best_match_all"))


def test_components_of_a_long_path(spark):
    nodes, edges = spark.range(300), spark.range(299).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in graph.connected_components(nodes, edges).collect()} == {0}


def test_components_count_repeated_nodes_once(spark):
    nodes, edges = spark.range(6).unionAll(spark.range(3)), spark.createDataFrame([(1, 0), (0, 1), (1, 2), (2, 3), (2, 3), (4, 4)], "a long, b long")
    assert sorted(tuple(r) for r in graph.connected_components(nodes, edges).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 5)]
    assert graph.connected_components(nodes.limit(0), edges.limit(0)).collect() == []


def test_close_pairs_meet_in_strips(spark):
    rng = random.Random(4)
    boxes = [(i % 3, i, rng.randint(-300, 900), rng.randint(0, 400), rng.choice([10, 40, 700]), rng.choice([10, 40, 90])) for i in range(120)]
    df = spark.createDataFrame(boxes, "image_id long, idx long, x long, y long, w long, h long")
    near = lambda p, q, d: p[2] <= q[2] + q[4] + d and q[2] <= p[2] + p[4] + d and p[3] <= q[3] + q[5] + d and q[3] <= p[3] + p[5] + d
    alike = lambda p, q: max(p[4] * p[5], q[4] * q[5]) <= 2.5 * min(p[4] * p[5], q[4] * q[5])
    want = sorted((p[0], p[1], q[1]) for p in boxes for q in boxes if p[0] == q[0] and p[1] < q[1] and near(p, q, 60) and alike(p, q))
    assert sorted(tuple(r) for r in graph.close_pairs(df).collect()) == want and want
    edges = spark.createDataFrame([w[1:] for w in want], "a long, b long")
    clusters = {r.idx: r.cluster for r in graph.box_clusters(df).collect()}
    assert clusters == {r.id: r.component for r in graph.connected_components(df.selectExpr("idx as id"), edges).collect()}


def test_box_ids_are_unique(spark):
    ids = _image_boxes(spark, "/root/testdata/sf0.1").select("idx")
    assert ids.count() == ids.distinct().count()


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(labels.class_label(F.lit(None).cast("int"), report=True)) == "unknown"
    assert get(labels.class_label(F.lit(-1))) == "license_plate"
    assert get(clock.parse_clock_text(F.lit("5026-06-26 12:14:02"), 2026)["seconds"]) == 1782476042.0
    assert get(clock.parse_clock_text(F.lit("26/06/2026 12.14.02"), 2026)["seconds"]) == 1782476042.0
    assert get(clock.parse_clock_text(F.lit("at 12:14:02"), 2026)["kind"]) == "time_of_day"
    assert get(clock.timestamp_from_path(F.lit("x/2026-07-03/12-30-15.jpg"))["seconds"]) == 1783081815.0
    assert get(clock.timestamp_from_path(F.lit("x/y/12-30-15.jpg"))["kind"]) == "time_of_day"
    assert get(clock.timestamp_from_path(F.lit("x/y/a.jpg"))) is None
    assert get(clock.format_hms(F.lit(90061))) == "01:01:01"
    assert get(vectors.normalize_plate(F.lit("a-1"))) is None
    assert get(vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert get(labels.video_group(F.lit("a.jpg"), F.lit(None).cast("string"))) == "(unknown video)"
    box = lambda *v: Box(*map(F.lit, v))
    assert get(geometry.box_intersects(box(0, 0, 5, 5), box(5, 0, 5, 5))) is False
    assert get(geometry.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert get(geometry.box_area(box(0, 0, -5, 5), clamp=True)) == 0
    assert get(filters.same_members(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1)))) is True
    with pytest.raises(Exception, match="no known class"):
        get(labels.resolve_classes(F.array(F.lit("nothing"))))
