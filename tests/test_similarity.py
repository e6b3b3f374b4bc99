"""Similar vectors by blocks around pivots, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parkflow.functions import vectors
from parkflow.operators import similarity, tracking

SCHEMA = "camera long, id long, label long, v array<double>"


def sides(df):
    return [df.select(F.col("camera").alias(f"{s}_camera"), F.col("id").alias(f"{s}_id"), F.col("label").alias(f"{s}_entity"), F.col("v").alias(f"{s}_v")) for s in "dg"]


def other():
    return F.when(F.col("d_id") == F.col("g_id"), -1.0).otherwise(vectors.cosine(F.col("d_v"), F.col("g_v")))


def clustered(n, rng, length=1.0):
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(n):
        v = centres[i % 12] + 0.15 * rng.normal(size=24)
        rows.append((i % 3 and 1, i, i % 36, (length * v / np.linalg.norm(v)).tolist()))
    return rows


@pytest.mark.parametrize(("threshold", "ratio", "length"), [(0.75, 0.8, 1.0), (0.95, 0.9, 1.0), (1.2, 1.0, 1.5)])
def test_best_matches_are_those_of_all_pairs(spark, threshold, ratio, length):
    rows = clustered(160, np.random.default_rng(1), length)
    rows += [(1, 900, 5, None), (7, 901, 5, rows[0][3]), (1, 902, 3, rows[1][3]), (1, 903, 4, rows[1][3]), (None, 904, 1, rows[2][3])]
    d, g = sides(spark.createDataFrame(rows, SCHEMA))
    want = tracking.best_match(tracking.similarity_candidates(d, g, other()), threshold, ratio)
    got = tracking.best_match(similarity.near_candidates(d, g, other(), similarity.decisive(threshold, ratio), block=32), threshold, ratio)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ratio == 0.8 or not want.isEmpty()


def test_blocks_far_apart_are_not_multiplied(spark):
    rows = [(0, i, i, v) for _, i, _, v in clustered(960, np.random.default_rng(2))]
    d, g = sides(spark.createDataFrame(rows, SCHEMA))
    left = similarity.blocks_apart(d, g, 0.7, block=16, n_pivots=16)
    assert 0 < similarity.share_compared(*left) < 0.3


def test_empty_sides(spark):
    d, g = sides(spark.createDataFrame(clustered(9, np.random.default_rng(3)), SCHEMA))
    for a, b in ((d, g.limit(0)), (d.limit(0), g), (d.limit(0), g.limit(0))):
        assert similarity.near_candidates(a, b, other(), 0.5).count() == 0
        assert similarity.share_compared(*similarity.blocks_apart(a, b, 0.5)) == 0


def test_what_best_match_hangs_on():
    assert similarity.decisive(0.75, 0.8) == pytest.approx(0.6875)
    assert similarity.decisive(0.75, 2.0) == 0.75


@pytest.mark.parametrize(("threshold", "ratio", "length"), [(0.75, 0.8, 1.0), (0.95, 0.9, 1.0), (1.2, 1.0, 1.5)])
def test_two_best_entities_decide_as_all_pairs_do(spark, threshold, ratio, length):
    rows = clustered(160, np.random.default_rng(4), length)
    rows += [(1, 900, 5, None), (7, 901, 5, rows[0][3]), (1, 902, 3, rows[1][3]), (1, 903, 4, rows[1][3]), (None, 904, 1, rows[2][3])]
    rows += [(1, 905, None, rows[4][3]), (1, 906, 7, [None, *rows[4][3][1:]]), (3, 907, 7, [float("nan")] * 24), (3, 908, 8, rows[0][3])]
    d, g = sides(spark.createDataFrame(rows, SCHEMA))
    want = tracking.best_match(tracking.similarity_candidates(d, g, other()), threshold, ratio)
    near = similarity.nearest_entities(d, g, similarity.decisive(threshold, ratio), block=16, wide=2, slices=3)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(tracking.best_match(near, threshold, ratio)) == order(want)


def test_pairs_do_not_leave_their_task(spark):
    same = clustered(1, np.random.default_rng(5))[0][3]
    d, g = sides(spark.createDataFrame([(0, i, i % 40, same) for i in range(400)], SCHEMA))
    assert similarity.near_candidates(d, g, other(), 0.7, block=64).count() > 10_000
    found = similarity.nearest_entities(d, g, 0.7, block=64, wide=64, slices=2)
    assert found.count() == 800 and {r.g_entity for r in found.select("g_entity").distinct().collect()} <= {0, 1}
    assert similarity.nearest_entities(d, g.limit(0), 0.7).count() == similarity.nearest_entities(d.limit(0), g, 0.7).count() == 0
