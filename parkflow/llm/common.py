"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkflow.tables import dropped, shared_folder, task, written as saved

__all__ = ["dropped", "heavy_join", "saved", "shared_folder", "table", "task"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy_join(big: DataFrame, small: DataFrame, on: list[str], meets: str, each: int = 5000, counts: DataFrame | None = None, spread: list[str] | None = None) -> DataFrame:
    """big joined with small on keys that are unique in small and never null. Column `meets` of small (dropped) says how
    many rows of big a key meets: a row of small that meets more than `each` is repeated, and the rows of big are dealt
    among its copies by hash (of the columns `spread`), so no task gets all of a heavy key. Neither side is broadcast.
    counts: the keys and `meets` alone, where small is costly to read twice."""
    parts = F.ceil(F.col(meets) / each).cast("int")
    heavy = saved((small if counts is None else counts).filter(F.col(meets) > each).select(*on, parts.alias("__parts")))
    if heavy.isEmpty():
        return big.join(small.drop(meets).hint("merge"), on)
    dealt = big.join(heavy, on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*(spread or big.columns)), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copies = small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(meets)
    return dealt.join(copies.hint("merge"), [*on, "__part"]).drop("__part")
