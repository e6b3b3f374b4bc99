"""Mechanisms that keep tasks bounded, against plain versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parkflow.operators import filters, plates, speed
from parkflow.sources import sinks
from parkflow.tables import exact_quantiles


@pytest.mark.parametrize("k", [2, 3, 4])
def test_pairs_of_plates_within_k(spark, k):
    rng = random.Random(k)
    texts = {"", "A", "AB", "XYZ", "ABCD"}
    for _ in range(25):
        t = "".join(rng.choice("ABC12") for _ in range(rng.randint(1, 12)))
        texts.add(t)
        for _ in range(3):
            s = list(t)
            for _ in range(rng.randint(1, k + 1)):
                at = rng.randrange(len(s) + 1)
                how = rng.randrange(3)
                s[at : at + (how > 0)] = [] if how == 1 else [rng.choice("ABC12")]
            texts.add("".join(s))
    want = set(map(tuple, duckdb.execute("with t as (select unnest(?) as x) select a.x, b.x from t a join t b on a.x < b.x and levenshtein(a.x, b.x) <= ?", [sorted(texts), k]).fetchall()))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("A",)], "plate_text string")
    got = plates.fuzzy_plate_pairs(df, k).collect()
    assert {(r.plate_text, r.other) for r in got} == want and len(got) == len(want)


def plain_skip(rows, n, skip):
    out, left = [], 0
    for frame, detections in sorted(rows):
        if frame % n == 0:
            if left:
                left -= 1
            else:
                out.append(frame)
                left = skip if detections == 0 else 0
    return out


@pytest.mark.parametrize(("n", "skip", "stretch"), [(1, 3, 4), (2, 5, 2), (3, 0, 4), (1, 1, 256)])
def test_adaptive_skipping_over_many_stretches(spark, monkeypatch, n, skip, stretch):
    monkeypatch.setattr(filters, "STRETCH", stretch)
    rng = random.Random(skip)
    rows = {v: [(i, rng.choice([0, 0, 1, 5])) for i in range(start, start + 300) if rng.random() < 0.9] for v, start in (("a", 0), ("b", 1000), ("c", -40))}
    df = spark.createDataFrame([(v, *r) for v, own in rows.items() for r in own], "video string, frame_index long, detections long")
    got = filters.adaptive_downsample(df, n, skip).collect()
    for v, own in rows.items():
        assert sorted(r.frame_index for r in got if r.video == v) == plain_skip(own, n, skip)
    assert filters.adaptive_downsample(df.limit(0), n, skip).collect() == []


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random(), 0.5, -3.0])) for g in ("a", "b", None) for _ in range(rng.choice([1, 2, 50, 51]))] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q0": 0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "q10": 1}
    by = {g: [v for k, v in rows if k == g and v is not None] for g in {k for k, _ in rows}}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {g for g, v in by.items() if v}
    for g, r in got.items():
        assert [r[c] for c in shares] == pytest.approx(np.quantile(by[g], list(shares.values())).tolist())
    every = exact_quantiles(df, [], "v", shares).collect()
    assert len(every) == 1 and every[0].mid == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert [tuple(r) for r in exact_quantiles(df.limit(0), [], "v", shares).collect()] == [(None,) * 5]
    assert exact_quantiles(df.limit(0), ["g"], "v", shares).collect() == []


def test_summaries_of_all_groups_at_once(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["v", "car", None]), rng.choice(["left", "right"]), rng.choice([0, 2, None]), rng.random(), rng.choice([None, rng.random() * 9])) for _ in range(60)]
    df = spark.createDataFrame(rows, "video string, direction string, entity_type int, relative_speed double, absolute_speed double")
    every = {(r.kind, r.label): r for r in speed.summarize_every(df).collect()}
    single = [("all", r.asDict() | {"label": "all"}) for r in speed.summarize_report(df).collect()]
    single += [(kind, r.asDict()) for kind, f in (("type", speed.summarize_by_type), ("video", speed.summarize_by_video)) for r in f(df).collect()]
    assert len(every) == len(single)
    for kind, r in single:
        assert every[kind, r["label"]].asDict() == pytest.approx(r | {"kind": kind})
    text = speed.summarize_every(df)._jdf.queryExecution().optimizedPlan().toString()
    assert speed.summarize_report(df.limit(0)).first().n == 0 and "Union" not in text


def test_replaced_partitions_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_by(spark.range(40).select("id", (F.col("id") % 4).alias("day"), F.lit("old").alias("v")), path, "day")
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("day=*/*.parquet")}
    done = spark.createDataFrame([(1, 1), (5, 1)], "id long, day long")
    sinks.replace_partitions(spark, path, "day", done, spark.createDataFrame([(5, 1, "new"), (100, 7, "new")], "id long, day long, v string"), "id")
    rows = {r.id: (r.day, r.v) for r in spark.read.parquet(path).collect()}
    assert rows[5] == (1, "new") and rows[100] == (7, "new") and 1 not in rows and rows[9] == (1, "old") and len(rows) == 40
    kept = {f for f in files if f.parent.name != "day=1"}
    assert kept and all(f.exists() and f.stat().st_mtime_ns == files[f] for f in kept)
