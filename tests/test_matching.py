"""Greedy matching, tracking and nearest claims against plain folds."""

import random

import pytest

from parkflow.operators import matching, tracking
from tests.test_queries import plain_tracks


@pytest.mark.parametrize("rounds", [1, 6])
def test_greedy_pairs(spark, rounds):
    rng = random.Random(rounds)
    edges = [(a, b, rng.randrange(6), rng.randrange(4)) for a in range(60) for b in range(50) if rng.random() < 0.08]
    used_l, used_r, want = set(), set(), set()
    for o1, o2, b, a in sorted((o1, o2, b, a) for a, b, o1, o2 in edges):
        if a not in used_l and b not in used_r:
            used_l.add(a), used_r.add(b), want.add((a, b))
    got = matching.greedy_pairs(spark.createDataFrame(edges, "l long, r long, o1 int, o2 int"), rounds).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("seed", "rounds"), [(1, 1), (2, 2), (3, 6)])
def test_greedy_chains(spark, seed, rounds):
    """With many equal scores, so that ties are settled by where chains begin."""
    rng = random.Random(seed)
    edges = [(a, b, b // 4, rng.randrange(3)) for a in range(120) for b in range(a + 1, min(120, a + 14)) if a // 4 < b // 4 and rng.random() < 0.5]
    begin, used = {i: i for i in range(120)}, set()
    for f in range(30):
        own, done = [e for e in edges if e[2] == f], set()
        for _, b, _, a in sorted((s, b, begin[a], a) for a, b, _, s in own):
            if a not in used and b not in done:
                used.add(a), done.add(b)
                begin[b] = begin[a]
    got = matching.greedy_chains(spark.range(120), spark.createDataFrame(edges, "l long, r long, o1 int, o2 int"), rounds).collect()
    assert {r.id: r.chain for r in got} == begin and len(got) == 120


def test_tracking_of_crowds(spark):
    """Boxes that cross, stop, hide and overlap all the time; equal ones too."""
    rng = random.Random(7)
    rows = set()
    for _ in range(60):
        x, y, dx, dy, f0 = rng.randrange(300), rng.randrange(200), rng.randint(-9, 9), rng.randint(-5, 5), rng.randrange(80)
        size = rng.choice([(40, 30), (50, 40), (200, 150)])
        rows |= {(f, x + dx * (f - f0), y + dy * (f - f0), *size) for f in range(f0, f0 + rng.randint(3, 40)) if rng.random() < 0.8}
    rows = sorted(rows)
    df = spark.createDataFrame([(v, *r, 2) for v in ("v", "w") for r in rows], "video string, frame_index long, x long, y long, w long, h long, class_id int")
    got = tracking.track_frames(df, 0.15, 1.0, 12.0).collect()
    want = plain_tracks(rows, 0.15, 12)
    for v in ("v", "w"):
        assert {(r.frame_index, r.x, r.y, r.w, r.h): r.track_id for r in got if r.video == v} == want
    assert len(set(want.values())) < len(rows) / 3
    assert tracking.track_frames(df.limit(0)).collect() == []


def plain_catalog(rows, times, gap):
    def iou(a, b):
        w, h = (min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i]) for i in (0, 1))
        both = max(0, w) * max(0, h)
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    live, out = [], {}
    for now in sorted({times[r[0]] for r in rows}):
        used = set()
        for r in sorted(x for x in rows if times[x[0]] == now):
            own = [(-iou(r[3:], t["box"]), k) for k, t in enumerate(live) if t["kind"] == r[2] and now - t["at"] < gap and k not in used and iou(r[3:], t["box"]) > 0]
            k = min(own)[1] if own else len(live)
            if not own:
                live.append({"id": r[1], "kind": r[2]})
            live[k] |= {"at": now, "box": r[3:]}
            used.add(k)
            out[r[:2]] = live[k]["id"]
    return out


def test_catalog_of_crowds(spark):
    rng = random.Random(2)
    times = {i: i * 10 + (100 if i > 20 else 0) for i in range(40)} | {40: 390, 41: 390}
    rows = [(i, 1000 * i + k, rng.randrange(2), rng.randrange(0, 300, 10), rng.randrange(0, 200, 10), 60, 40) for i in times for k in range(12)]
    df = spark.createDataFrame(rows, "image_id long, entity_id long, type_id int, x long, y long, width long, height long")
    images = spark.createDataFrame(list(times.items()), "image_id long, epoch_s long")
    got = tracking.track_catalog(df, images, 25.0).collect()
    assert {(r.image_id, r.entity_id): r.new_id for r in got} == plain_catalog(rows, times, 25.0) and len(got) == len(rows)


@pytest.mark.parametrize("rounds", [0.4, 3.0])
def test_nearest_claims(spark, rounds):
    rng = random.Random(5)
    cars = [(rng.choice("ab"), i, round(rng.random() * 40, 1)) for i in range(150)]
    tracks = [(rng.choice("ab"), i, round(rng.random() * 40, 1)) for i in range(130)]
    want, taken = set(), set()
    for rec, car, t in sorted(cars, key=lambda c: (c[2], c[1])):
        own = sorted((abs(u - t), k) for r, k, u in tracks if r == rec and k not in taken and t - rounds <= u <= t + rounds)
        if own:
            taken.add(own[0][1])
            want.add((rec, car, own[0][1]))
    kinds = ("recording string, car_id long, t double", "recording string, track_id long, t double")
    got = tracking.nearest_time_match(spark.createDataFrame(cars, kinds[0]), spark.createDataFrame(tracks, kinds[1]), rounds).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("gap", "ratio", "spread"), [(None, 0.8, 0.3), (30.0, 0.95, 0.5), (12.0, 0.99, 0.9), (50.0, 1.0, 0.6)])
def test_reidentification_of_crowds(spark, gap, ratio, spread):
    """Blocks of a few rows, equal features, zero ones, and decisions that hang on one another."""
    import math

    rng = random.Random(ratio)
    kinds = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = [(c, i, float(i // 2 + 40 * (i > 80)), [x + rng.gauss(0, spread) for x in kinds[rng.randrange(6)]]) for c in "ab" for i in range(120)]
    rows += [("a", 200, 3.0, [0.0] * 4), ("a", 201, 4.0, [0.0] * 4), ("b", 202, 30.0, rows[30][3]), ("b", 203, 31.0, rows[30][3])]
    want = {}
    for c in "ab":
        seen, n = [], 0
        for _, i, t, v in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            best = {}
            for k, s, u in seen:
                if gap is None or s >= t - gap:
                    norm = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
                    best[k] = max(best.get(k, -1.0), round(sum(x * y for x, y in zip(u, v)) / norm, 12) if norm else 0.0)
            order = sorted(best.items(), key=lambda x: (-x[1], x[0]))
            ok = bool(order) and order[0][1] >= 0.7 and (len(order) < 2 or max(1 - order[0][1], 1e-6) / max(1 - order[1][1], 1e-6) <= ratio)
            n += not ok
            want[c, i] = order[0][0] if ok else n
            seen.append((want[c, i], t, v))
    df = spark.createDataFrame(rows, "camera string, profile_id long, t double, feature array<double>")
    got = tracking.reidentify(df, 0.7, ratio, gap, block=16).collect()
    assert {(r.camera, r.profile_id): r.entity_id for r in got} == want and len(got) == len(rows)
