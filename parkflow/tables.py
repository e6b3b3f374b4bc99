"""Intermediate tables in the folder that all machines of the cluster share, and functions that run in tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and Spark runs in one process."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again: lineage ends here, and a lost executor costs
    no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/parkflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._parkflow_path = path
    return table


def dropped(table: DataFrame) -> None:
    """Delete a table made by `written` that no later plan reads, such as the last round's of an iteration."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._parkflow_path)
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def task(module: str, name: str, sides: int = 1, **args) -> Callable:
    """``module.name`` as a function for mapInArrow or applyInPandas; with two sides, for a cogroup.

    The module is imported on the worker, so what it caches lives as long as the worker does. Broadcast values
    among the arguments are opened there.
    """
    root = ROOT

    def run(first, *more):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        own = {k: v.value if type(v).__name__ == "Broadcast" else v for k, v in args.items()}
        return getattr(importlib.import_module(module), name)(first, *more, **own)

    return (lambda first, second: run(first, second)) if sides == 2 else (lambda first: run(first))


def exact_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each share, the exact quantile of a column in each group, linear between the two nearest values;
    nulls don't count, and groups without values are missing. Without keys there is always one row, of nulls where there
    are no values.

    The values are range-sorted by group and value, and the rows at the wanted ranks are picked by their numbers: no task
    holds all values of a group, as the engine's own percentile does.
    """
    rows = written(numbered(df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("value")), [*keys, "value"], "at"))
    sizes = rows.groupBy(*keys).agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 0")
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (F.col("first") + F.floor(place(p))).alias("low"), (F.col("first") + F.ceil(place(p))).alias("high"), (place(p) - F.floor(place(p))).alias("share")) for name, p in shares.items()])
    asked = sizes.select(*keys, F.explode(asked).alias("x")).select(*keys, "x.*")
    at = lambda name: rows.select(F.col("at").alias(name), F.col("value").alias(f"{name}_value"))
    found = asked.join(at("low"), "low").join(at("high"), "high").withColumn("value", F.col("low_value") + (F.col("high_value") - F.col("low_value")) * F.col("share"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares])


def numbered(df: DataFrame, by: list[str | Column], into: str = "pos", sums: tuple[str, ...] = ()) -> DataFrame:
    """df with the number of each row, from 0, in the order of some columns, and before_<c>, what column c of the rows
    ahead of it adds up to, for each of `sums`.

    The rows are range-sorted and written; only the parts' sizes and sums, one row each, are summed in one place.
    """
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("__at"))
    parts = written(parts)
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums])
    every = Window.orderBy("__part")
    sizes = sizes.select("__part", ahead("__n", every).alias("__before"), *[ahead(f"__{c}", every).alias(f"__{c}") for c in sums])
    own = Window.partitionBy("__part").orderBy("__at")
    found = parts.join(sizes, "__part").withColumns({into: F.col("__before") + F.col("__at")} | {f"before_{c}": F.col(f"__{c}") + ahead(c, own) for c in sums})
    return found.drop("__part", "__at", "__before", *[f"__{c}" for c in sums])
