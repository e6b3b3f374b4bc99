"""Boxes of which many are equal, against plain folds over every copy."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from parkflow.operators import tracking
from parkflow.streaming import streams
from tests.test_streams_in_order import at, run, shuffled, stream


def plain(rows, least, alive):
    """(row, track) of each of the rows(frame, x, y, w, h, kind), copies included."""
    live, out, following = [], [], 1
    for frame in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == frame)
        live = [t for t in live if frame - t[1] <= alive]

        def iou(a, b):
            w, h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
            both = max(0, w) * max(0, h)
            return both / (a[3] * a[4] + b[3] * b[4] - both)

        pairs = sorted((-iou(r, t[2]), i, k) for i, r in enumerate(own) for k, t in enumerate(live) if iou(r, t[2]) >= least)
        of, used = {}, set()
        for _, i, k in pairs:
            if i not in of and k not in used:
                of[i] = live[k][0]
                used.add(k)
                live[k][1:] = [frame, own[i]]
        for i, r in enumerate(own):
            if i not in of:
                live.append([following, frame, r])
                of[i] = following
                following += 1
            out.append((r, of[i]))
    return out


def crowd(seed, copies):
    """Boxes on a coarse grid that come in copies, so that overlaps are equal all the time."""
    rng = random.Random(seed)
    rows = []
    for _ in range(24):
        x, y, dx, dy, f0 = rng.randrange(0, 160, 8), rng.randrange(0, 120, 8), rng.choice([-8, 0, 4, 8]), rng.choice([-4, 0, 4]), rng.randrange(70)
        size = rng.choice([(40, 32), (40, 32), (80, 64)])
        for f in range(f0, f0 + rng.randint(3, 25)):
            if rng.random() < 0.8:
                rows += [(f, x + dx * (f - f0), y + dy * (f - f0), *size, rng.randrange(3)) for _ in range(rng.randint(1, copies))]
    return rows


@pytest.mark.parametrize(("seed", "copies", "each"), [(1, 1, 250_000), (2, 5, 250_000), (3, 5, 30), (4, 2, 60)])
def test_copies_are_tracked_as_single_boxes_are(spark, seed, copies, each):
    rows = {v: crowd(seed + 10 * k, copies) for k, v in enumerate("vw")}
    df = spark.createDataFrame([(v, *r) for v in rows for r in rows[v]], "video string, frame_index long, x long, y long, w long, h long, class_id int")
    got = [tuple(r) for r in tracking.track_frames(df.repartition(3), 0.15, 1.0, 8.0, each).collect()]
    want = [(v, *r, track) for v in rows for r, track in plain(rows[v], 0.15, 8)]
    assert sorted(got) == sorted(want) and len({(w[0], w[-1]) for w in want}) < len(want) / 2


def test_no_row_is_lost_without_video_frame_or_place(spark):
    rows = [("v", 1, 0, 0, 9, 9, 2), ("v", 2, 1, 0, 9, 9, 2), ("v", 2, None, 0, 9, 9, 2), ("v", 2, None, 0, 9, 9, None), ("v", 3, 1, 0, 9, 9, None), ("v", None, 1, 0, 9, 9, 1), ("v", None, 1, 0, 9, 9, 1), (None, 1, 0, 0, 9, 9, 2), (None, 2, 0, 0, 9, 9, 2)]
    df = spark.createDataFrame(rows, "video string, frame_index long, x long, y long, w long, h long, class_id int")
    got = {(*r[:3], r[6], r[7]) for r in tracking.track_frames(df).collect()}
    # Those without a frame come first in order, then those of frame 2 without a place before those with one.
    assert got == {("v", None, 1, 1, 1), ("v", None, 1, 1, 2), ("v", 1, 0, 2, 3), ("v", 2, 1, 2, 3), ("v", 3, 1, None, 3), ("v", 2, None, None, 4), ("v", 2, None, 2, 5), (None, 1, 0, 2, 1), (None, 2, 0, 2, 2)}


def test_copies_cost_no_pairs():
    """30,000 copies of each of 20 boxes in 40 frames: 360 billion pairs."""
    rows = [(20 * f + k, "v", 0, f, 100.0 * k + 3 * f, 5.0, 40.0, 30.0, 30_000 + (f * k) % 7) for f in range(40) for k in range(20)]
    df = pd.DataFrame(rows, columns=["id", "video", "part", "frame_index", "x", "y", "w", "h", "n"])
    began = time.process_time()
    found, handed = tracking._bundled("video", "frame_index", 60, 0.15)(df, [])
    assert time.process_time() - began < 5
    own = found[found["id"] >= 0]
    assert own.groupby("id")["n"].sum().tolist() == df["n"].tolist()
    begun = (own["head"] + own["n"]).max()
    assert 600_000 < begun < 601_000 and handed[0].sum() == begun and len(own) < 8 * len(df)
    assert np.isfinite(handed[2]).all()


def test_copies_are_counted_in_a_table(spark):
    """A frame's copies don't wait for one another in pairs; rows come out one for each."""
    df = spark.range(120_000).selectExpr("'v' as video", "id % 3 as frame_index", "id % 2 * 100 + id % 3 as x", "0L as y", "50L as w", "40L as h", "cast(id % 5 as int) as class_id")
    got = tracking.track_frames(df)
    assert got.count() == 120_000
    per = got.groupBy("track_id").count()
    assert per.count() == 40_000 and per.filter("count = 3").count() == 40_000


def test_copies_in_a_stream_are_tracked_as_in_a_table(spark, tmp_path):
    schema = "video string, ts timestamp, frame_index long, x int, y int, w int, h int"
    rows = [(v, at(f / 10), f, *b[:4]) for k, v in enumerate("ab") for f, *b in crowd(20 + k, 6)]
    last = [(v, at(100), 1000, 0, 0, 5, 5) for v in "ab"]
    df = stream(spark, tmp_path / "in", [*shuffled(rows, lambda r: r[2] / 10, 3.0, 1500, random.Random(1)), last], schema)
    got, _ = run(streams.stream_tracks(df, "4 seconds", 0.15, 8, 10.0), tmp_path)
    want = {}
    for v in "ab":
        for r, track in plain([(f, *b, 2) for w, _, f, *b in rows if w == v], 0.15, 8):
            want.setdefault((v, track), []).append(r[0])
    assert sorted(map(tuple, got.collect())) == sorted((*k, min(f), max(f), len(f)) for k, f in want.items())


def test_equal_boxes_go_through_as_one(spark):
    """However many copies, in turn: 200,000 rows of 12 different boxes in 3 frames, no more than 10,000 rows held."""
    df = spark.range(200_000).selectExpr("'v' as video", "timestamp_seconds(id % 3) as ts", "id % 3 as frame_index", "cast(id % 4 as double) as x", "0D as y", "1D as w", "2D as h").coalesce(1)
    got = df.mapInArrow(streams._framed(10_000, counted=True), "video string, ts timestamp, frame_index long, boxes binary").collect()
    boxes = {r.frame_index: np.frombuffer(r.boxes).reshape(-1, 5) for r in got}
    assert len(got) == 3 and all(len(b) == 4 for b in boxes.values()) and sum(b[:, 4].sum() for b in boxes.values()) == 200_000


def test_copies_cost_a_stream_no_pairs():
    """20,000 copies of each of 10 boxes in 50 frames."""

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    tracks = streams._Tracks(0.15, 50, 25.0)
    tracks.following, tracks.live = Value(), Value()
    due = pd.DataFrame({streams.AT: [40_000 * f for f in range(50)], "frame_index": range(50), "boxes": [np.array([(100.0 * k + f, 5.0, 40.0, 30.0, 20_000) for k in range(10)]).tobytes() for f in range(50)]})
    began = time.process_time()
    out = [r for half in (due[:25], due[25:]) for r in tracks.take(("v",), iter([half]), int(half[streams.AT].max()))]
    assert sum(map(len, out)) == 0 and tracks.following.get() == (200_001,)
    out = pd.concat(list(tracks.take(("v",), iter([]), 10_000_000_000)))
    assert time.process_time() - began < 5 and not tracks.live.exists()
    assert sorted(out["track_id"]) == list(range(1, 200_001)) and (out["boxes"] == 50).all() and (out["last_frame"] == 49).all()
