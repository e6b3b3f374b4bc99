"""The composed analyses, and the entry point without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

from parkflow.plans import reports

ROOT = Path(__file__).resolve().parents[1]


def test_plate_dwell(spark):
    a = spark.createDataFrame([("a/1.jpg", "ab-12", 1.0), ("a/2.jpg", "AB 12", 9.0)], "img_path string, plate_text string, t double")
    b = spark.createDataFrame([("b/3.jpg", "AB12", 5.0), ("b/4.jpg", "x", 6.0)], "img_path string, plate_text string, t double")
    manifest = spark.createDataFrame([("a/2.jpg", 21.0, 0)], "img_path string, timestamp double, folder int")
    matches, stats = reports.run_plate_dwell([a, b], manifest)
    assert [(r.plate_text, r.dwell, r.sightings) for r in matches.collect()] == [("AB12", 20.0, 3)]
    assert stats.first().asDict() | {"images": 4, "plates_read": 3, "average_dwell": 20.0} == stats.first().asDict()


def test_dwell_benchmark(spark):
    rows = [("1", "P1", "P1", 0.0), ("2", "P1", "P1", 5.0), ("3", "QQQQ", "QQQQ", 0.0), ("4", "QQQQ", "ZZZZ", 9.0), ("5", "RRRR", None, 0.0), ("6", "RRRR", None, 3.0), ("7", "SSSS", "SSSS", 0.0), ("8", "SSSS", None, 8.0), ("9", "SSSS", "SSSS", 4.0)]
    crossings, summary = reports.run_plate_dwell_benchmark(spark.createDataFrame(rows, "img_path string, truth string, plate_text string, t double"), 1, 1.0)
    assert {r.truth: r.status for r in crossings.collect()} == {"P1": "exact", "QQQQ": "split", "RRRR": "dropped", "SSSS": "corrupted"}
    assert summary.first().mean_abs_delta == 4.0


def test_occupancy(spark):
    rows = [("s", 1, 10.0, [1.0, 0.0]), ("s", 2, 30.0, [0.0, 1.0])]
    schema = "camera string, profile_id long, t double, feature array<double>"
    timeline, stats = reports.run_occupancy(spark.createDataFrame(rows, schema), spark.createDataFrame([("s", 9, 20.0, [1.0, 0.0])], schema))
    assert [r.occupancy for r in timeline.orderBy("t").collect()] == [1, 0, 1]
    assert stats.first().max_occupancy == 1
    profile = reports.run_profile(spark.createDataFrame([*rows, ("s", 3, 31.0, [0.0, 0.9])], schema)).collect()
    assert sorted((r.entity_id, r.t, r.sightings, r.first_t, r.last_t) for r in profile) == [(1, 10.0, 1, 10.0, 10.0), (2, 30.0, 2, 30.0, 31.0), (2, 31.0, 2, 30.0, 31.0)]


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['parkflow.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=100).returncode == 0
