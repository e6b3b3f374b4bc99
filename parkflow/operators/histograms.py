"""Comparing distributions of speeds between days.

A histogram is rows (direction, label, bin, n); a row of it is one direction and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkflow.functions.vectors import minmax_scale, nearest_bin
from parkflow.operators.filters import report_scope
from parkflow.tables import exact_quantiles

ROW = ("direction", "label")


def zero_filled(hist: DataFrame) -> DataFrame:
    """With a row for every bin of each direction."""
    grid = hist.select(*ROW).distinct().join(hist.select("direction", "bin").distinct(), "direction")
    return grid.join(hist, ["direction", "label", "bin"], "left").fillna(0, ["n"])


def row_distribution(hist: DataFrame) -> DataFrame:
    """Adds p, the share of the row; a row without counts is an error."""
    total = F.sum("n").over(Window.partitionBy(*ROW))
    return hist.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(F.raise_error(F.lit("a row has no counts")).cast("double")))


def row_variance(hist: DataFrame) -> DataFrame:
    """Population variance of the bins of each row."""
    p = row_distribution(hist)
    m = F.sum(F.col("p") * F.col("bin"))
    return p.groupBy(*ROW).agg((F.sum(F.col("p") * F.col("bin") * F.col("bin")) - m * m).alias("variance"))


def last_n_rows(hist: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("direction").orderBy(F.col("label").desc())
    last = hist.select(*ROW).distinct().withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
    return hist.join(last, list(ROW), "left_semi")


def evenly_spaced(hist: DataFrame, rows: int) -> DataFrame:
    """At most so many rows of each direction, the first and the last among them."""
    w = Window.partitionBy("direction").orderBy("label")
    numbered = hist.select(*ROW).distinct().withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("direction")))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: F.bround(k * (F.col("n") - 1) / max(1, rows - 1), 0).cast("int"))
    keep = numbered.filter((F.col("n") <= rows) | F.array_contains(wanted, F.col("i")))
    return hist.join(keep, list(ROW), "left_semi")


def histogram_pairs(hist: DataFrame) -> DataFrame:
    """Each pair of rows of a direction, bin by bin: n and p of both."""
    full = row_distribution(zero_filled(hist))
    a = full.select("direction", "bin", F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("p").alias("p_a"))
    b = full.select("direction", "bin", F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("p").alias("p_b"))
    return a.join(b, ["direction", "bin"]).filter("label_a < label_b")


def _pearson() -> Column:
    """1 for equal rows and 0 for others where one of them is constant."""
    constant = (F.min("n_a") == F.max("n_a")) | (F.min("n_b") == F.max("n_b"))
    n, sa, sb = F.count("*"), F.sum("n_a"), F.sum("n_b")
    top = n * F.sum(F.col("n_a") * F.col("n_b")) - sa * sb
    va, vb = n * F.sum(F.col("n_a") * F.col("n_a")) - sa * sa, n * F.sum(F.col("n_b") * F.col("n_b")) - sb * sb
    below = F.sqrt(va.cast("double")) * F.sqrt(vb.cast("double"))
    return F.when(constant, F.when(F.bool_and(F.col("n_a") == F.col("n_b")), 1.0).otherwise(0.0)).otherwise(top / F.when(below > 0, below))


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon, base 2, as a sum over bins."""
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / F.when(m > 0, m))).otherwise(0.0)
    return F.sum((half(p) + half(q)) / 2)


def compare_histograms(hist: DataFrame) -> DataFrame:
    """pearson, js_divergence and overlap of each pair of rows."""
    p, q = F.col("p_a"), F.col("p_b")
    return histogram_pairs(hist).groupBy("direction", "label_a", "label_b").agg(_pearson().alias("pearson"), _divergence(p, q).alias("js_divergence"), F.sum(F.least(p, q)).alias("overlap"))


def is_stable(pairs: DataFrame, js: float = 0.1, overlap: float = 0.85) -> DataFrame:
    ok = (F.col("js_divergence") <= js) & (F.col("overlap") >= overlap)
    return pairs.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("stable"))


def stability_summary(pairs: DataFrame, variances: DataFrame, js: float = 0.1, overlap: float = 0.85) -> DataFrame:
    """By direction: pairs, those within the thresholds, the worst pair, and the variances' mean, least and most."""
    ok = (F.col("js_divergence") <= js) & (F.col("overlap") >= overlap)
    worst = F.max(F.struct(F.round("js_divergence", 9).alias("js"), "label_a", "label_b"))
    a = pairs.groupBy("direction").agg(F.count("*").alias("pairs"), F.count_if(ok).alias("within"), worst.alias("w"))
    b = variances.groupBy("direction").agg(F.avg("variance").alias("mean_variance"), F.min("variance").alias("min_variance"), F.max("variance").alias("max_variance"))
    return a.join(b, "direction").select("direction", "pairs", "within", F.col("w.label_a").alias("worst_a"), F.col("w.label_b").alias("worst_b"), F.col("w.js").alias("worst_js"), "mean_variance", "min_variance", "max_variance")


def scaled(df: DataFrame, column: str, low: float, high: float, into: str) -> DataFrame:
    """df with a column stretched to [low, high]. The least and the largest value come from an aggregation, as one row."""
    ends = df.agg(F.min(column).alias("__least"), F.max(column).alias("__most"))
    return df.crossJoin(F.broadcast(ends)).withColumn(into, minmax_scale(F.col(column), low, high, F.col("__least"), F.col("__most"))).drop("__least", "__most")


def report_histogram(entities: DataFrame, bins: list[float], entity_type: int | None = None, direction: str | None = None) -> DataFrame:
    """bin and n of a report's speeds: absolute ones if there are any, else relative ones stretched over the bins."""
    own = report_scope(entities, entity_type, direction)
    absolute = own.agg(F.count("absolute_speed").alias("__n"))
    stretched = scaled(own, "relative_speed", min(bins), max(bins), "__s")
    value = F.when(F.col("__n") > 0, F.col("absolute_speed")).otherwise(F.col("__s"))
    binned = stretched.crossJoin(F.broadcast(absolute)).select(nearest_bin(value, bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = entities.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(b)) for b in bins])).alias("bin"))
    return every.join(binned, "bin", "left").fillna(0, ["n"])


def report_match(reports: DataFrame, history: DataFrame, js: float = 0.1, overlap: float = 0.85) -> DataFrame:
    """How each report (direction, label, bin, n) fits the mean of the distributions of history's rows."""
    mean = row_distribution(zero_filled(history)).groupBy("direction", "bin").agg(F.avg("p").alias("q"))
    own = row_distribution(zero_filled(reports)).join(mean, ["direction", "bin"], "left").fillna(0.0, ["q"])
    out = own.groupBy(*ROW).agg(_divergence(F.col("p"), F.col("q")).alias("js_divergence"), F.sum(F.least("p", "q")).alias("overlap"))
    return out.withColumn("passed", (F.col("js_divergence") <= js) & (F.col("overlap") >= overlap))


def speed_histogram(df: DataFrame, column: str) -> DataFrame:
    """bin, low, high and n with bins of the width that numpy's `auto` takes."""
    v = F.col(column).cast("double")
    quarters = exact_quantiles(df.select(v.alias("v")), [], "v", {"q1": 0.25, "q3": 0.75})
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).crossJoin(F.broadcast(quarters))
    spread = F.col("high") - F.col("low")
    fd = F.least(2 * (F.col("q3") - F.col("q1")) / F.cbrt(F.col("n").cast("double")), spread / (2 * F.sqrt("n")))
    sturges = spread / (F.log2(F.col("n").cast("double")) + 1)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    s = s.withColumn("bins", F.greatest(F.lit(1), F.when(width > 0, F.ceil(spread / F.when(width > 0, width))).otherwise(1)).cast("int")).filter("n > 0")
    step = (F.col("high") - F.col("low")) / F.col("bins")
    at = F.when(step > 0, F.least(F.floor((v - F.col("low")) / F.when(step > 0, step)), F.col("bins") - 1)).otherwise(0).cast("int")
    counted = df.filter(v.isNotNull()).crossJoin(F.broadcast(s)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = s.select("low", step.alias("step"), F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("step")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("count", F.lit(0)).alias("n"))


def dwell_histogram(matches: DataFrame, bins: int = 24) -> DataFrame:
    """bin and n over log-spaced bins from 0.9 of the least to 1.1 of the most positive counted dwell; one bin where
    all are equal."""
    own = matches.filter("counted and dwell > 0").select(F.col("dwell").cast("double").alias("dwell"))
    s = own.agg(F.min("dwell").alias("low"), F.max("dwell").alias("high"))
    ratio = F.ln(F.col("high") * 1.1) - F.ln(F.col("low") * 0.9)
    at = F.when(F.col("low") == F.col("high"), 0).otherwise(F.least(F.floor((F.ln("dwell") - F.ln(F.col("low") * 0.9)) / ratio * bins), F.lit(bins - 1))).cast("int")
    return own.crossJoin(F.broadcast(s)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def ridgeline_points(hist: DataFrame, points: int = 240) -> DataFrame:
    """Each row's distribution, linear between its bins, at so many x."""
    p = row_distribution(zero_filled(hist))
    w = Window.partitionBy(*ROW).orderBy("bin")
    parts = p.withColumns({"next_bin": F.lead("bin").over(w), "next_p": F.lead("p").over(w)}).filter("next_bin is not null")
    ends = p.groupBy("direction").agg(F.min("bin").cast("double").alias("low"), F.max("bin").cast("double").alias("high"))
    xs = ends.select("direction", "high", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "low").withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (points - 1))
    inside = (F.col("x") >= F.col("bin")) & ((F.col("x") < F.col("next_bin")) | ((F.col("x") == F.col("high")) & (F.col("next_bin") == F.col("high"))))
    return parts.join(F.broadcast(xs), "direction").filter(inside).select(*ROW, "i", "x", (F.col("p") + (F.col("next_p") - F.col("p")) * (F.col("x") - F.col("bin")) / (F.col("next_bin") - F.col("bin"))).alias("y"))
