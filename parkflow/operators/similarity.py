"""Similar vectors without comparing all: rows in blocks around pivots, blocks apart ruled out by the triangle inequality."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkflow.tables import numbered, written


def decisive(threshold: float, ratio: float) -> float:
    """The least similarity that `best_match` of these two can hang on: one of `threshold` is clear against all below."""
    return min(threshold, 1 - max(1 - threshold, 1e-6) / ratio)


def _to_pivots(pivots: np.ndarray) -> Callable[[Column], Column]:
    """The distance of a vector to each pivot."""

    @F.pandas_udf("array<double>")
    def far(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.empty((0, 0))
        return pd.Series(list(np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)))

    return far


def _stacked(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _products(least: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """d_at and g_at of the rows of two blocks whose product isn't under `least`, rounding included."""

    def pairs(d: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"d_at": [], "g_at": []}, dtype="int64")]
        if len(d) and len(g):
            a, b, d_at, g_at = _stacked(d["v"]), _stacked(g["v"]), d["at"].to_numpy(), g["at"].to_numpy()
            size = np.linalg.norm(b, axis=1)
            for k in range(0, len(a), 256):
                own = a[k : k + 256]
                i, j = np.nonzero(~(own @ b.T < least - 1e-9 * (1 + np.linalg.norm(own, axis=1)[:, None] * size)))
                out.append(pd.DataFrame({"d_at": d_at[k + i], "g_at": g_at[j]}))
        return pd.concat(out)

    return pairs


def _bounded(rows: DataFrame, n_pivots: int) -> DataFrame:
    """For each block: rows, the greatest squared length, and the least and greatest distance to each pivot."""
    ends = [f(F.col("far")[k]).alias(f"{name}{k}") for k in range(n_pivots) for name, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("camera", "block").agg(F.count("*").alias("n"), F.max("long").alias("long"), *ends)


def blocks_apart(detections: DataFrame, gallery: DataFrame, least: float, block: int = 1024, n_pivots: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of both sides with at, camera, v and block, and the pairs of blocks (camera, d, g, n_d, n_g) that may hold
    a product of `least`.

    Pivots are some vectors of the gallery, whichever they are. Rows are range-sorted by camera, nearest pivot and the
    distance to it, and cut into blocks. No two rows of two blocks are nearer than the gap between the blocks' distances
    to any pivot, and a product is half of what the squared lengths exceed the squared distance by. Blocks are compared
    with blocks of their camera, many to a task, so that a busy camera is many tasks. Null vectors are left out.
    """
    sides = [df.filter(F.col(f"{s}_v").isNotNull()) for df, s in ((detections, "d"), (gallery, "g"))]
    some = sides[1].select("g_v").orderBy(F.xxhash64("g_v")).limit(n_pivots).collect()
    pivots = np.array([r.g_v for r in some], dtype=float)
    far = _to_pivots(pivots) if some else lambda v: F.array().cast("array<double>")
    rows = []
    for df, s in zip(sides, "dg"):
        own = df.withColumns({"camera": F.col(f"{s}_camera"), "v": F.col(f"{s}_v"), "far": far(F.col(f"{s}_v"))})
        own = own.withColumns({"near": F.array_position("far", F.array_min("far")), "own": F.array_min("far"), "long": F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))})
        own = numbered(own, ["camera", "near", "own"], "at").withColumn("block", F.floor(F.col("at") / block))
        rows.append(written(own.drop("near", "own")))
    summaries = [written(_bounded(r, len(some))) for r in rows]
    slices = [-(-s.count() // 512) or 1 for s in summaries]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = summaries[0].withColumn("da", F.pmod("block", F.lit(slices[0]))).withColumn("db", every(slices[1])).alias("a")
    b = summaries[1].withColumn("da", every(slices[0])).withColumn("db", F.pmod("block", F.lit(slices[1]))).alias("b")
    gaps = [F.col(f"{x}.lo{k}") - F.col(f"{y}.hi{k}") for k in range(len(some)) for x, y in (("a", "b"), ("b", "a"))]
    apart = F.greatest(F.lit(0.0), F.lit(0.0), *gaps)
    longest = F.col("a.long") + F.col("b.long")
    may = F.coalesce((longest - apart * apart) / 2 + 1e-9 * (1 + longest) >= least, F.lit(True))
    meet = (F.col("a.camera") == F.col("b.camera")) & (F.col("a.da") == F.col("b.da")) & (F.col("a.db") == F.col("b.db"))
    pairs = a.join(b, meet & may).select("a.camera", F.col("a.block").alias("d"), F.col("b.block").alias("g"), F.col("a.n").alias("n_d"), F.col("b.n").alias("n_g"))
    return rows[0], rows[1], written(pairs)


def share_compared(d: DataFrame, g: DataFrame, pairs: DataFrame) -> float:
    """The share of all products within cameras that the pairs of blocks leave; 0 where there is none."""
    n = d.groupBy("camera").count().join(g.groupBy("camera").agg(F.count("*").alias("m")), "camera").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    return (pairs.agg(F.sum(F.col("n_d") * F.col("n_g"))).first()[0] or 0) / n if n else 0.0


def near_candidates(detections: DataFrame, gallery: DataFrame, similarity: Column, least: float, block: int = 1024, n_pivots: int = 16) -> DataFrame:
    """As `similarity_candidates` without a time limit, but for pairs whose product of d_v and g_v is under `least`: d_id,
    g_entity and the best similarity. What is left out can't change `best_match` where least is `decisive(...)` and the
    similarity is never above the product (colour counts for 0.3 at most: (least - 0.3) / 0.7 is enough for a fused one).

    Only pairs of blocks that may hold such a product are multiplied, each in a task of its own as two matrices; the
    similarity itself is a column over the pairs found. Vectors are of one length.
    """
    d, g, pairs = blocks_apart(detections, gallery, least, block, n_pivots)
    side = lambda rows, which: rows.select("camera", F.col("block").alias(which), "at", "v").join(pairs.select("camera", "d", "g"), ["camera", which]).groupBy("camera", "d", "g")
    found = side(d, "d").cogroup(side(g, "g")).applyInPandas(_products(least), "d_at long, g_at long")
    own = lambda rows, s: rows.withColumnRenamed("at", f"{s}_at").drop("camera", "v", "far", "long", "block")
    both = found.join(own(d, "d"), "d_at").join(own(g, "g"), "g_at")
    return both.withColumn("__s", similarity).groupBy("d_id", "g_entity").agg(F.max("__s").alias("similarity"))


def _two(i: np.ndarray, e: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each i the two entities e of the greatest s, each with its greatest; the smaller e if tied. NaN is the greatest."""
    high = np.where(np.isnan(s), np.inf, s)
    order = np.lexsort((-high, e, i))
    i, e, s, high = (v[order] for v in (i, e, s, high))
    new = np.append(True, (i[1:] != i[:-1]) | (e[1:] != e[:-1]))[: len(i)]
    i, e, s, high = (v[new] for v in (i, e, s, high))
    order = np.lexsort((e, -high, i))
    i, e, s = (v[order] for v in (i, e, s))
    top = np.append([True, True], i[2:] != i[:-2])[: len(i)]
    return i[top], e[top], s[top]


def _two_best(least: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The two best entities of each row of d among the rows of g, of the pairs of blocks that d lists in rows without v.
    What products can't rule out is summed up anew in the vector's order, so that the result is that of a column."""

    def found(d: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        pairs, d, g = d[d["v"].isna()], d[d["v"].notna()].sort_values("block"), g.sort_values(["block", "e"])
        out = [pd.DataFrame({"d_id": d["id"][:0], "e": g["e"][:0], "s": pd.Series([], dtype=float), "none": pd.Series([], dtype=bool)})]
        if not len(d) or not len(g):
            return out[0]
        a, b, id_a, id_b, e = _stacked(d["v"]), _stacked(g["v"]), d["id"].to_numpy(), g["id"].to_numpy(), g["e"].to_numpy("int64")
        size_a, size_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        spans = [{k: np.searchsorted(x, [k, k + 1]) for k in np.unique(x)} for x in (d["block"].to_numpy(), g["block"].to_numpy())]
        for block, own in pairs.groupby("block")["other"]:
            begin, end = spans[0][block]
            for at in range(begin, end, 256):
                to = min(at + 256, end)
                floor, tops = np.full(to - at, least), []
                for low, high in (spans[1][int(k)] for k in own):
                    near = a[at:to] @ b[low:high].T
                    near = np.where(id_a[at:to, None] == id_b[None, low:high], -np.inf, np.where(np.isnan(near), np.inf, near))
                    starts = np.flatnonzero(np.append(True, e[low + 1 : high] != e[low : high - 1]))
                    if len(starts) > 1:
                        floor = np.maximum(floor, np.partition(np.maximum.reduceat(near, starts, axis=1), -2, axis=1)[:, -2])
                    slack = np.nan_to_num(1e-9 * (1 + size_a[at:to, None] * size_b[None, low:high]))
                    i, j = np.nonzero((near >= floor[:, None] - slack) & (near > -np.inf))
                    s, j = np.zeros(len(i)), j + low
                    for c in range(a.shape[1]):
                        s += a[at + i, c] * b[j, c]
                    tops.append(_two(i, e[j], s))
                i, best, s = _two(*(np.concatenate(c) for c in zip(*tops)))
                out.append(pd.DataFrame({"d_id": id_a[at + i], "e": best, "s": s, "none": np.isnan(s)}))
        return pd.concat(out)

    return found


def nearest_entities(detections: DataFrame, gallery: DataFrame, least: float, block: int = 1024, n_pivots: int = 16, wide: int = 64, slices: int = 32) -> DataFrame:
    """As `near_candidates` where the similarity is the product of d_v and g_v and no row meets that of its own id: d_id,
    g_entity and the best similarity, but of each d_id only the two best entities (the smaller, if tied) and some more
    beside them, which is all that `best_match` looks at.

    Pairs of blocks are gone through in cells: about `slices` slices of the detections by `wide` blocks of the gallery, each
    a task that holds its rows (no more than `wide` blocks on a side) and goes through them block by block. A vector goes to
    as many cells as there are slices of its camera, whatever the tables' size, until slices are `wide` blocks too; pairs
    never leave their task.
    """
    whole = lambda v: F.coalesce(~F.exists(v, F.isnull), F.lit(False))
    entities = written(numbered(gallery.select("g_entity").distinct(), ["g_entity"], "e"))
    known = gallery.filter(whole("g_v")).join(entities.withColumnRenamed("g_entity", "__e"), F.col("g_entity").eqNullSafe(F.col("__e")))
    d, g, pairs = blocks_apart(detections.filter(whole("d_v")), known, least, block, n_pivots)
    last = pairs.agg(F.max("d")).first()[0] or 0
    each = max(1, min(wide, -(-(last + 1) // slices)))
    pairs = pairs.select("camera", F.floor(F.col("d") / each).alias("__d"), F.floor(F.col("g") / wide).alias("__g"), "d", "g")
    cell = ["camera", "__d", "__g"]
    to = lambda which: pairs.select(*cell, F.col(which).alias("block")).distinct()
    left = d.select("camera", "block", F.col("d_id").alias("id"), "v").join(to("d"), ["camera", "block"])
    left = left.unionByName(pairs.select(*cell, F.col("d").alias("block"), F.col("g").alias("other")), allowMissingColumns=True)
    right = g.select("camera", "block", F.col("g_id").alias("id"), "e", "v").join(to("g"), ["camera", "block"])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    kind = detections.schema["d_id"].dataType.simpleString()
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_two_best(least), f"d_id {kind}, e long, s double, none boolean")
    found = found.withColumn("s", F.when(F.col("none"), F.lit(float("nan"))).otherwise(F.col("s")))  # pandas has NaN for nulls
    return found.groupBy("d_id", "e").agg(F.max("s").alias("similarity")).join(entities, "e").select("d_id", "g_entity", "similarity")
