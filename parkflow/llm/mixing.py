"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the training run. Its target is the schedule's integral (after no source is
repeated more often than allowed); the words taken from it by time t are the target times the share of the integral up
to t. A document stands at the time at which this demand reaches its place in its source's order, found by inverting
the demand, and range-sorting by that time gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkflow.llm.common import saved
from parkflow.tables import numbered

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target and weight for sizes(source, source_size).

    Sources by code point, null last, weigh `weights`, repeating. The targets share the sum of all sizes by weight; a
    target stops at `epochs` times its source's size and the rest is shared again. The k sources that stop first are
    those with the least room for their weight, so running sums over the sources in that order (taken over a range sort)
    find who stops.
    """
    by_name = numbered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1)
    ranked = by_name.withColumn("weight", w.cast("long")).withColumn("room", F.lit(epochs) * F.col("source_size") / F.col("weight"))
    ranked = numbered(ranked, ["room", F.col("source").asc_nulls_last()], "order", ("source_size", "weight"))
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))))
    left, open_ = F.col("all_sizes") - epochs * F.col("before_source_size"), F.col("all_weights") - F.col("before_weight")
    first = ranked.agg(F.min(F.when(left / open_ <= F.col("room"), F.struct("room", left.alias("left"), open_.alias("weights")))).alias("first"))
    ranked = ranked.crossJoin(F.broadcast(first))  # one row each
    most = (epochs * F.col("source_size")).cast("double")
    target = F.least(most, F.col("weight") * (F.col("first.left") / F.col("first.weights")))
    return ranked.select("source", "source_size", "weight", F.when(F.col("first").isNull(), most).otherwise(target).alias("target"))


def slope(weight):
    """How a source's schedule changes: weight 1 fades out over the run, 2 holds, 3 fades in."""
    return F.when(weight == 1, -0.5).when(weight == 3, 0.5).otherwise(0.0)


def time_of(share, gradient):
    """Inverse of the cumulative demand t + g * (t^2 - t), for a schedule 1 + g * (2t - 1)."""
    g = F.when(gradient == 0, 1.0).otherwise(gradient)
    root = (F.sqrt((1 - g) * (1 - g) + 4 * g * share) - (1 - g)) / (2 * g)
    return F.when(gradient == 0, share).otherwise(root)


def mix_sources(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_position and positions for every row of
    docs(doc_id, text, source), range-sorted by first_position.

    Within a source the documents stand in the order of a hash of doc_id. The mix goes through it as often as the
    target asks for; its last round ends at the word where the target is reached, so the document there gives its
    first words only. positions has one place (0 to 1) in the training run for each round that takes words of the
    document, and first_position is the first of them, null where nothing is taken. A null or empty text has size 0 and
    nothing taken; a null source is a source. Repeated rows are documents each.

    The running sum is taken in two levels, within 4096 slices of each source by hash and over the slices' sums, so
    no source is ordered by one task. What is sorted are these numbers, without the texts.
    """
    out = placed(docs, epochs, weights)
    positions = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda r: F.when(words_of_round(r) > 0, _place(r)))
    out = out.withColumn("positions", F.array_compact(positions))
    out = saved(out.select("doc_id", "source", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"), "positions"))
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def words_of_round(r: Column) -> Column:
    """The words that round 0, 1, ... takes of a placed document."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - r * F.col("source_size") - F.col("start")))


def _place(r: Column) -> Column:
    start = F.col("start") + r * F.col("source_size")
    return time_of((start + F.col("size") / 2) / F.greatest(F.col("target"), start + F.col("size")), slope(F.col("weight")))


def placed(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), ties: tuple[str, ...] = ()) -> DataFrame:
    """As mix_sources, with start (the words of the source ahead of the document), weight and the columns `ties`. Those
    order documents of one doc_id and size, and stand for a doc_id that is null."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *ties)
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    rows = rows.withColumn("rank", F.md5(F.coalesce(F.col("doc_id").cast("string"), *[F.col(c).cast("string") for c in ties], F.lit("")).cast("binary"))).withColumn("slice", F.substring("rank", 1, 3))
    rows = saved(rows)  # the texts' words are counted once
    slices = rows.groupBy("key", "slice").agg(F.sum("size").alias("slice_size"))
    sizes = slices.groupBy("key").agg(F.sum("slice_size").alias("source_size")).withColumn("source", F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)))
    targets = source_targets(sizes.select("source", "source_size"), epochs, weights)
    over = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_from", F.coalesce(F.sum("slice_size").over(over), F.lit(0)))
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    slices = slices.join(targets, "key").select("key", "slice", "slice_from", "source_size", "target", "weight")
    within = Window.partitionBy("key", "slice").orderBy("rank", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(slices, ["key", "slice"])
    start = F.col("slice_from") + F.col("ahead")
    whole = F.floor(F.col("target"))
    rounds = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = whole - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), start.alias("start"), "weight", *ties)


def place_of_copy(copy: Column) -> Column:
    """Position of a placed document's copy 0, 1, ...: each round goes through the whole source once more."""
    share = (F.col("start") + F.col("size") / 2 + copy * F.col("source_size")) / F.col("target")
    return time_of(F.least(F.lit(1.0), share), slope(F.col("weight")))


def training_order(mix: DataFrame) -> DataFrame:
    """The documents that the mix takes, range-sorted by their first position: files written from it follow the
    curriculum's first round."""
    return mix.filter("taken > 0").repartitionByRange(F.col("first_position"), F.col("doc_id")).sortWithinPartitions("first_position", "doc_id")


def training_rounds(mix: DataFrame) -> DataFrame:
    """What the mix takes, a row for each round with its position, range-sorted by it: files written from it follow the
    whole curriculum."""
    rounds = mix.withColumn("position", F.explode("positions")).drop("positions")
    return rounds.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
