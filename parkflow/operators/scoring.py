"""Confusion matrices and the direction benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parkflow.functions.labels import label_from_filename


def read_labeled_images(listing: DataFrame, labels: list[str], path: str = "name") -> DataFrame:
    """Files whose name holds one valid label, with it."""
    return listing.withColumn("truth", label_from_filename(F.col(path), labels)).filter("truth is not null")


def primary_box(boxes: DataFrame, key: str = "image_id", w: str = "w", h: str = "h") -> DataFrame:
    """The largest box of each image, the first if tied."""
    order = Window.partitionBy(key).orderBy((F.col(w) * F.col(h)).desc(), "idx")
    return boxes.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def direction_totals(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def label_metrics(pairs: DataFrame) -> DataFrame:
    """Support, true positives, precision, recall and F1 of each true label; 0 where a denominator is."""
    cells = confusion_matrix(pairs)
    rows = cells.groupBy("truth").agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("tp"))
    columns = cells.groupBy(F.col("predicted").alias("truth")).agg(F.sum("n").alias("said"))
    out = rows.join(columns, "truth", "left").fillna(0, ["said"])
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return out.select("truth", "support", "tp", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def label_counts(pairs: DataFrame, order: list[str]) -> DataFrame:
    """label, n_truth and n_predicted for each label of `order`; a label outside it is an error."""
    names = pairs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in order])).alias("label"))
    long = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    counted = long.groupBy("label").agg(F.sum("t").alias("n_truth"), F.sum("p").alias("n_predicted"))
    out = names.join(counted, "label", "full").withColumn("label", F.when(F.col("label").isin(*order), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unexpected label: "), "label"))))
    return out.fillna(0)


def direction_benchmark(images: DataFrame, boxes: DataFrame, labels: list[str]) -> DataFrame:
    """truth and predicted for labelled images(name): the label of the largest box, no_detection without one."""
    best = primary_box(boxes, "name").select("name", F.col("label").alias("predicted"))
    return read_labeled_images(images, labels).join(best, "name", "left").select("name", "truth", F.coalesce("predicted", F.lit("no_detection")).alias("predicted"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))


def detection_totals(detections: DataFrame, classes: dict[int, str]) -> DataFrame:
    """Count of each class asked for, 0 where there is none."""
    names = detections.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("label")) for i, n in classes.items()])).alias("c")).select("c.*")
    return names.join(detections.groupBy("class_id").agg(F.count("*").alias("n")), "class_id", "left").fillna(0, ["n"]).select("label", "n")
