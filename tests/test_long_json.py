"""Long reports in parts: the same rows as from the whole document, wherever splits fall."""

import bz2
import json
import random

import pytest

from parkflow.plans.exchange import a_long_reports
from parkflow.sources import long_json, sinks
from parkflow.sources.long_json import listed_objects
from parkflow.sources.readers import read_image_detections, read_video_detections


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, n) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


ODD = ["a.mp4", "a}b{.mp4", 'q"uo\\te.mp4', "x\\", ": [{", "é😀", ""]


def report(rng):
    def text():
        return rng.choice([*ODD, '"', '\\"}', "plain", "},{", "\n\t"])

    def one():
        nested = {text(): {"n": {"m": text()}}, "list": [text(), {"z": {}}]} if rng.random() < 0.3 else {}
        return {**nested, "frame_index": rng.randrange(99), "box": [rng.randrange(9) * 1.5 for _ in range(4)], "class_id": 2, "label": text(), "confidence": 0.5}

    detections = {name: [one() for _ in range(rng.choice([0, 0, 1, 7]))] for name in ODD}
    other = {"info": {"detections": {"no": [{"frame_index": 1}]}, "t": text()}, "text": text(), "empty": {}, "more": {"k": [{"frame_index": 5}]}}
    tail = {"after": {"z": [{"frame_index": 9}]}, "end": text()} if rng.random() < 0.5 else {}
    return {**(other if rng.random() < 0.7 else {}), "detections": detections, **tail}


@pytest.mark.parametrize(("seed", "size"), [(1, 64), (2, 300), (3, 1 << 20)])
def test_parts_hold_what_documents_hold(spark, tmp_path, small_splits, seed, size):
    rng, want = random.Random(seed), []
    for k in range(4):
        document = report(rng)
        (tmp_path / f"{k}.json").write_text(json.dumps(document, ensure_ascii=k % 2 == 0, indent=(None, 1)[k % 2]) + "\n" * (k // 2), encoding="utf-8")
        want += [(video, d) for video, own in document["detections"].items() for d in own]
    small_splits(size)
    got = [(r.key, json.loads(r.value)) for r in listed_objects(spark, str(tmp_path), "detections").collect()]
    order = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert order(got) == order(want) and want


def test_readers_in_parts(spark, tmp_path, small_splits):
    document = {"detections": {f"v{k}.mp4": [{"frame_index": i, "box": [i, 2, i + 3, 9.5], "class_id": 2, "label": str(k), "confidence": 0.25} for i in range(k * 20)] for k in range(4)}}
    (tmp_path / "long.json").write_text(json.dumps(document))
    small_splits(1000)
    for read in (read_video_detections, read_image_detections):
        whole, parts = (sorted(map(tuple, read(spark, str(tmp_path), in_parts).collect())) for in_parts in (False, True))
        assert whole == parts and len(whole) == 120


def test_a_report_without_objects_and_a_broken_one(spark, tmp_path):
    for k, text in enumerate(["", "{}", '{"detections": {}}', '{"detections": {"a": [], "b": []}}\n', '{"detections": null}']):
        (tmp_path / str(k)).write_text(text)
        assert listed_objects(spark, str(tmp_path / str(k)), "detections").count() == 0
    for k, text in enumerate(['{"detections": {"a": [{"b": 1}', '{"detections": {"a": [{"b": "1}]}}']):
        (tmp_path / f"broken{k}").write_text(text)
        with pytest.raises(Exception, match="not whole JSON"):
            listed_objects(spark, str(tmp_path / f"broken{k}"), "detections").collect()


@pytest.mark.parametrize("size", [3000, 20_000])
def test_compressed_reports_in_parts(spark, tmp_path, small_splits, size):
    """Blocks of bzip2 are splits; each object is written once, whatever the splits."""
    rng, want = random.Random(size), []
    for k in range(2):
        detections = {f"{name}{k}": [{"n": i, "id": rng.random(), "t": rng.choice(ODD), **({"in": {"}": {}}} if i % 50 == 0 else {})} for i in range(5000)] for name in ("a", "b}{", 'q"')}
        document = {"detections": {"none": [], **detections}, "more": {"k": [{"n": 1}]}}
        (tmp_path / f"{k}.txt.bz2").write_bytes(bz2.compress(json.dumps(document, ensure_ascii=k > 0, indent=(None, 1)[k]).encode(), 1))
        want += [(key, json.dumps(d)) for key, own in detections.items() for d in own]
    small_splits(size)
    tables, plain = [], long_json.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(long_json, "written", lambda df: tables.append(plain(df)) or tables[-1])
        found = listed_objects(spark, str(tmp_path), "detections")
    assert sorted((r.key, json.dumps(json.loads(r.value))) for r in found.collect()) == sorted(want)
    assert 8 < tables[0].count() and sum(t.count() for t in tables) < len(want) + 1 + 6 * tables[0].count()


def test_documents_of_listed_objects(spark, tmp_path):
    rows = [(f'v"{k}', json.dumps({"k": k, "i": i})) for k in range(5) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, one string").repartition(3, "key").sortWithinPartitions("key")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        sinks.write_listed(df, str(tmp_path / "out"), "d")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    texts = [bz2.decompress(p.read_bytes()).decode() for p in (tmp_path / "out").glob("*.bz2")]
    got = [(key, json.dumps(d)) for text in texts if text for key, own in json.loads(text)["d"].items() for d in own]
    assert sorted(got) == sorted(rows)


def test_long_reports_are_written_once(spark):
    """Beside the records, only a few rows for each split."""
    tables, plain = [], long_json.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(long_json, "written", lambda df: tables.append(plain(df)) or tables[-1])
        n = a_long_reports(spark, "/root/testdata/sf0.001").count()
    assert n and sum(t.count() for t in tables) < 1.2 * n
