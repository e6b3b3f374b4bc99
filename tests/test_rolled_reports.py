"""Reports over several files, and pieces that are counted many at a time."""

import gzip
import json
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from parkflow.sources import long_json, sinks
from parkflow.sources.long_json import listed_objects
from parkflow.sources.readers import read_video_detections
from tests.test_long_json import ODD, small_splits  # noqa: F401


def counted(piece):
    """Quotes, opening braces, and those of them outside a text, one character after the other."""
    quotes = braces = opened = at = 0
    while at < len(piece):
        if piece[at] == "\\":
            at += 1
        elif piece[at] == '"':
            quotes += 1
        elif piece[at] == "{":
            braces, opened = braces + 1, opened + (quotes % 2 == 0)
        at += 1
    return quotes, braces, opened


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_pieces(seed):
    rng = random.Random(seed)
    letters = ['"', "{", "é", "😀", ",", " "] + ["\\\\", '\\"', "\\{"] * (seed > 0)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 5, 60]))) for _ in range(400)] + [""]
    texts = pa.array(["{", *pieces])[1:]
    assert [tuple(map(int, c)) for c in zip(*long_json._counts(texts))] == [counted(p) for p in pieces]


def test_many_pieces_are_counted_together():
    piece = '{"frame_index":12,"box":[1.0,2.0,3.0,4.0],"class_id":2,"label":"car","confidence":0.5'
    batch = pa.RecordBatch.from_pydict({"split": [0] * 200_001, "begun": [0] * 200_001, "before": [0] * 200_001, "text": ['{"d": {"a": [' + piece] + ["," + piece] * 200_000})
    began = time.process_time()
    out = pa.Table.from_batches(long_json._recorded(iter([batch]), 0), long_json.RECORDS)
    assert time.process_time() - began < 2
    assert out.num_rows == 200_002 and out["text"].to_pylist()[1:-1] == [piece + "}"] * 200_000
    assert out["ended"].null_count == 1
    lists = pa.Table.from_batches(long_json._recorded(iter([batch]), 128), long_json.RECORDS).filter(pc.field("ended") & ~pc.field("first"))
    assert [len(json.loads(t)) for t in lists["text"].to_pylist()] == [128] * 1562 + [64]


@pytest.mark.parametrize(("each", "size"), [(25, 1 << 20), (400, 300), (100_000, 1 << 20)])
def test_reports_over_several_files(spark, tmp_path, small_splits, each, size):  # noqa: F811
    rng = random.Random(each)
    rows = [(f"{k}{name}", json.dumps({"i": i, "t": rng.choice([*ODD, '}"{', "\\"]), "in": {"}": [{}]}}) + " " * (i % 3)) for k in range(5) for name in ODD[:4] for i in range(rng.choice([1, 90]))]
    df = spark.createDataFrame(rows, "key string, one string").repartition(3, "key").sortWithinPartitions("key")
    sinks.write_listed(df, str(tmp_path / "out"), "d", each)
    files = sorted((tmp_path / "out").glob("*.gz"))
    assert len(files) >= min(3, len(rows) // each)
    tasks = {}
    for f in files:
        tasks.setdefault(f.name.split("-c")[0], []).append(gzip.decompress(f.read_bytes()).decode())
    whole = [(key, d) for texts in tasks.values() if "".join(texts) for key, own in json.loads("".join(texts))["d"].items() for d in own]
    small_splits(size)
    got = [(r.key, json.loads(r.value)) for r in listed_objects(spark, str(tmp_path / "out"), "d", rolled=True).collect()]
    order = lambda found: sorted(json.dumps(r) for r in found)
    assert order(got) == order(whole) == order((key, json.loads(one)) for key, one in rows)
    lists = [(r.key, json.loads(r.value)) for r in listed_objects(spark, str(tmp_path / "out"), "d", rolled=True, most=9).collect()]
    assert order((key, d) for key, own in lists for d in own) == order(got) and len(lists) < len(got) and max(len(own) for _, own in lists) <= 9


def test_a_missing_file_of_a_report_is_an_error(spark, tmp_path):
    rows = [("a", json.dumps({"i": i})) for i in range(100)]
    sinks.write_listed(spark.createDataFrame(rows, "key string, one string").coalesce(1), str(tmp_path / "out"), "d", 10)
    files = sorted((tmp_path / "out").glob("*.gz"))
    rest = [str(f) for i, f in enumerate(files) if i != 4]
    assert len(files) > 9
    with pytest.raises(Exception, match="a file is missing"):
        listed_objects(spark, rest, "d", rolled=True).collect()
    with pytest.raises(Exception, match="not one of a document's files"):
        (tmp_path / "other.json").write_text("{}")
        listed_objects(spark, str(tmp_path / "other.json"), "d", rolled=True).collect()


def test_what_is_no_object_is_not_written():
    batch = pa.RecordBatch.from_pydict({"key": ["a", "a"], "one": ['{"b": 1}', "7"]})
    with pytest.raises(ValueError, match="not an object"):
        list(sinks.listed_lines(iter([batch]), "d"))


def test_repeated_objects_are_written_fast(spark, tmp_path):
    """Equal objects, which bzip2 sorts slowly: 800,000 of them, a file for each 200,000."""
    df = spark.range(800_000, numPartitions=1).selectExpr("'v' as key", """concat('{"frame_index":', id div 50000, ',"box":[1.0,2.0,3.0,4.0],"label":"car"}') as one""")
    began = time.time()
    sinks.write_listed(df, str(tmp_path / "out"), "d", 200_000)
    assert time.time() - began < 20
    files = sorted((tmp_path / "out").glob("*.gz"))
    assert len(files) == 5 and sum(f.stat().st_size for f in files) < 4_000_000
    assert np.sum([gzip.decompress(f.read_bytes()).count(b"frame_index") for f in files]) == 800_000


@pytest.mark.parametrize("box", ['"no list"', "[1, 2, 3, {}]", "[1, 2, 3, 4"])
def test_a_wrong_object_is_an_error(spark, tmp_path, box):
    """Objects are parsed as lists; one that doesn't fit fails the read, wherever it stands in its list."""
    good = '{"frame_index": 1, "box": [1, 2, 3, 4], "class_id": 2, "label": "car", "confidence": 0.5}'
    bad = good.replace("[1, 2, 3, 4]", box)
    (tmp_path / "good.json").write_text('{"detections": {"v": [%s]}}' % ", ".join([good] * 40))
    (tmp_path / "bad.json").write_text('{"detections": {"v": [%s]}}' % ", ".join([good, good, bad, good]))
    assert read_video_detections(spark, str(tmp_path / "good.json"), in_parts=True).count() == 40
    with pytest.raises(Exception, match="(?i)malformed"):
        read_video_detections(spark, str(tmp_path / "bad.json"), in_parts=True).collect()
