"""How full a site is over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def entry_exit_events(seen: DataFrame) -> DataFrame:
    """site, t, entity_id, step: +1 at the first time of each entity at an entry, -1 at the last at an exit.

    seen: site, side (entry or exit), entity_id, t."""
    first = seen.filter("side = 'entry'").groupBy("site", "entity_id").agg(F.min("t").alias("t")).withColumn("step", F.lit(1))
    last = seen.filter("side = 'exit'").groupBy("site", "entity_id").agg(F.max("t").alias("t")).withColumn("step", F.lit(-1))
    return first.unionByName(last)


def running_occupancy(events: DataFrame) -> DataFrame:
    """events with occupancy, entered_total and exited_total so far; entries come before exits at one time. Occupancy
    is lifted so that it never falls below 0.

    Totals run in two levels, within days and over the days' sums, so that a busy site isn't one sort.
    """
    day = events.withColumn("day", F.floor(F.col("t") / DAY_US))
    sums = day.groupBy("site", "day").agg(F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).alias("i"), F.sum(F.when(F.col("step") < 0, 1).otherwise(0)).alias("o"))
    before = Window.partitionBy("site").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("site", "day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "io"])
    w = Window.partitionBy("site", "day").orderBy("t", F.col("step").desc(), "entity_id").rowsBetween(Window.unboundedPreceding, 0)
    run = day.withColumns({"i": F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).over(w), "o": F.sum(F.when(F.col("step") < 0, 1).otherwise(0)).over(w)}).join(sums, ["site", "day"])
    run = run.select("site", "t", "entity_id", "step", (F.col("i") + F.col("i_before")).alias("entered_total"), (F.col("o") + F.col("o_before")).alias("exited_total"))
    run = run.withColumn("running", F.col("entered_total") - F.col("exited_total"))
    lift = run.groupBy("site").agg((-F.least(F.lit(0), F.min("running"))).alias("lift"))
    return run.join(lift, "site").withColumn("occupancy", F.col("running") + F.col("lift")).drop("running", "lift")


def occupancy_stats(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("site").agg(F.max("occupancy").alias("max_occupancy"), F.count_if(F.col("step") > 0).alias("total_entered"), F.count_if(F.col("step") < 0).alias("total_exited"), F.count_distinct("entity_id").alias("entities"))
