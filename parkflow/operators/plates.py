"""Dwell times from plate readings, and how good the readings are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkflow.functions.labels import miss_bucket, relative_error_bucket
from parkflow.functions.vectors import within_edits
from parkflow.operators.graph import connected_components
from parkflow.tables import exact_quantiles

STATUSES = ("dropped", "split", "corrupted", "exact")


def attach_manifest(readings: DataFrame, manifest: DataFrame) -> DataFrame:
    """readings(img_path, t) with the manifest's time where it has one; the last of several folders counts.

    manifest: img_path, timestamp, folder (a number)."""
    last = manifest.groupBy("img_path").agg(F.max(F.struct("folder", "timestamp"))["timestamp"].alias("__t"))
    return readings.join(last, "img_path", "left").withColumn("t", F.coalesce("__t", "t")).drop("__t")


def pool_directories(*readings: DataFrame) -> DataFrame:
    out = readings[0]
    for df in readings[1:]:
        out = out.unionByName(df)
    return out


def _dwell(groups: DataFrame, key: str) -> DataFrame:
    """One row for each group of readings(plate_text, t, img_path): first and last sighting, texts by how often."""
    first, last = F.min(F.struct("t", "img_path")), F.max(F.struct("t", "img_path"))
    out = groups.groupBy(key).agg(first.alias("a"), last.alias("b"), F.count("*").alias("sightings"))
    columns = [F.col("a.t").alias("entry"), F.col("b.t").alias("exit"), F.col("a.img_path").alias("entry_image"), F.col("b.img_path").alias("exit_image"), (F.col("b.t") - F.col("a.t")).alias("dwell"), "sightings"]
    return out.select(key, *columns)


def plate_dwell_exact(readings: DataFrame) -> DataFrame:
    """A row for each text: plate_text, entry, exit, their images, dwell, sightings. Once seen isn't a match."""
    return _dwell(readings.filter("plate_text is not null"), "plate_text")


def _by_variants(texts: DataFrame, k: int) -> DataFrame:
    """Pairs of texts(plate_text) that have a common variant after k deletions at most."""
    variants = texts.select("plate_text", F.array(F.col("plate_text")).alias("v"))
    for _ in range(k):
        shorter = F.flatten(F.transform("v", lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        variants = variants.select("plate_text", F.array_distinct(F.concat("v", shorter)).alias("v"))
    variants = variants.select("plate_text", F.explode("v").alias("variant"))
    other = variants.withColumnRenamed("plate_text", "other")
    return variants.join(other, "variant").filter("plate_text < other").select("plate_text", "other").distinct()


def _by_segments(texts: DataFrame, k: int) -> DataFrame:
    """Pairs of texts of which one of the k + 1 even segments of the shorter stands in the longer, moved by k places at
    most: k edits can't touch all of them. A text has (k + 1) keys and probes (k + 1)^2 (2 k + 1) at most, whatever its
    length, where variants after k deletions grow with its k-th power."""
    size = lambda n, i: F.floor(n / (k + 1)) + F.when(i > k - n % (k + 1), 1).otherwise(0)
    begin = lambda n, i: i * F.floor(n / (k + 1)) + F.greatest(F.lit(0), i - (k + 1 - n % (k + 1)))
    every = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("segment")
    keys = texts.select("plate_text", F.length("plate_text").alias("size"), every)
    n, i = F.col("size"), F.col("segment")
    keys = keys.select("plate_text", "size", "segment", F.substring(F.col("plate_text"), (begin(n, i) + 1).cast("int"), size(n, i).cast("int")).alias("piece"))
    long = F.length("other")
    probes = texts.select(F.col("plate_text").alias("other")).select("other", F.explode(F.sequence(F.greatest(F.lit(0), long - k), long)).alias("size")).select("other", "size", every)
    probes = probes.select("*", F.explode(F.sequence(F.greatest(F.lit(0), begin(n, i) - k), F.least(long - size(n, i), begin(n, i) + k))).alias("at")).filter(F.col("at") + size(n, i) <= long)
    probes = probes.select("other", "size", "segment", F.substring(F.col("other"), (F.col("at") + 1).cast("int"), size(n, i).cast("int")).alias("piece")).distinct()
    found = keys.join(probes, ["size", "segment", "piece"]).filter("plate_text <> other")
    return found.select(F.least("plate_text", "other").alias("plate_text"), F.greatest("plate_text", "other").alias("other")).distinct()


def fuzzy_plate_pairs(readings: DataFrame, k: int) -> DataFrame:
    """Pairs of different texts within k edits, without comparing all: for up to two edits two such texts have a common
    variant after k deletions at most, for more a common segment. What meets so is verified."""
    texts = readings.filter("plate_text is not null").select("plate_text").distinct()
    pairs = _by_variants(texts, k) if k < 3 else _by_segments(texts, k)
    return pairs.filter(within_edits(F.col("plate_text"), F.col("other"), k))


def fuzzy_groups(readings: DataFrame, k: int) -> DataFrame:
    """plate_text and plate_group (the least text that pairs lead to)."""
    pairs = fuzzy_plate_pairs(readings, k).withColumnsRenamed({"plate_text": "a", "other": "b"})
    nodes = readings.filter("plate_text is not null").select(F.col("plate_text").alias("id")).distinct()
    return connected_components(nodes, pairs).withColumnsRenamed({"id": "plate_text", "component": "plate_group"})


def gap_sessions(readings: DataFrame, gap: float) -> DataFrame:
    """Readings with session: of one text, those not further apart than gap."""
    w = Window.partitionBy("plate_text").orderBy("t", "img_path")
    new = (F.col("t") - F.lag("t").over(w) > gap).cast("int")
    return readings.withColumn("session", F.coalesce(F.sum(new).over(w), F.lit(0)))


def fuzzy_sessions(readings: DataFrame, k: int, gap: float) -> DataFrame:
    """Readings with plate_group when texts within k edits and readings within gap belong together.

    Nodes are the sessions of each text. Two sessions of similar texts link where a reading of one is within gap of a
    reading of the other: readings meet in time buckets of one gap and their neighbours only.
    """
    own = gap_sessions(readings.filter("plate_text is not null"), gap).withColumn("node", F.concat_ws("#", "plate_text", "session"))
    bucket = F.floor(F.col("t") / max(gap, 1e-9))
    left = own.select(F.col("plate_text").alias("lt"), F.col("node").alias("a"), F.col("t").alias("ta"), bucket.alias("bucket"))
    right = own.select(F.col("plate_text").alias("rt"), F.col("node").alias("b"), F.col("t").alias("tb"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    pairs = fuzzy_plate_pairs(readings, k)
    met = left.join(pairs, F.col("lt") == F.col("plate_text")).join(right, (F.col("other") == F.col("rt")) & (left["bucket"] == right["bucket"])).filter(F.abs(F.col("ta") - F.col("tb")) <= gap)
    groups = connected_components(own.select(F.col("node").alias("id")).distinct(), met.select("a", "b").distinct())
    return own.join(groups.withColumnsRenamed({"id": "node", "component": "plate_group"}), "node").drop("node", "session")


def _voted(groups: DataFrame) -> DataFrame:
    """plate_group, plate_text (the most frequent, the earliest if tied) and variants."""
    votes = groups.groupBy("plate_group", "plate_text").agg(F.count("*").alias("n"), F.min(F.struct("t", "img_path")).alias("first"))
    best = Window.partitionBy("plate_group").orderBy(F.col("n").desc(), "first")
    named = votes.withColumn("r", F.row_number().over(best)).groupBy("plate_group")
    return named.agg(F.max(F.when(F.col("r") == 1, F.col("plate_text"))).alias("plate_text"), F.array_join(F.array_sort(F.collect_list("plate_text")), ",").alias("variants"))


def plate_dwell_fuzzy(readings: DataFrame, k: int = 1, gap: float | None = None) -> DataFrame:
    """As plate_dwell_exact for groups of texts within k edits, named by majority, with their variants."""
    groups = readings.join(fuzzy_groups(readings, k), "plate_text") if gap is None else fuzzy_sessions(readings, k, gap)
    return _dwell(groups, "plate_group").join(_voted(groups), "plate_group").drop("plate_group")


def plate_dwell(readings: DataFrame, k: int = 0, gap: float | None = None, least_dwell: float = 0.0) -> DataFrame:
    """Matches (seen twice or more) with counted: whether they dwelt long enough for the average. Without edits the gap
    isn't looked at."""
    rows = plate_dwell_exact(readings) if k <= 0 else plate_dwell_fuzzy(readings, k, gap)
    return rows.filter("sightings >= 2").withColumn("counted", F.col("dwell") >= least_dwell)


def average_dwell(matches: DataFrame) -> DataFrame:
    return matches.agg(F.coalesce(F.avg(F.when(F.col("counted"), F.col("dwell"))), F.lit(0.0)).alias("average_dwell"), F.count_if(~F.col("counted")).alias("excluded"))


def truth_to_cluster(truths: DataFrame, groups: DataFrame) -> DataFrame:
    """truths(img_path, truth, t) with the group that its picture was read into, if any."""
    return truths.join(groups.select("img_path", "plate_group"), "img_path", "left")


def classify_crossings(truths: DataFrame, groups: DataFrame, ocr: DataFrame) -> DataFrame:
    """Status of each true plate seen twice or more: dropped (in no group), split (in several), exact (one group of the
    same pictures), corrupted (else), with true dwell and that of the group.

    truths: img_path, truth, t; groups: img_path, plate_group; ocr: plate_group, dwell."""
    joined = truth_to_cluster(truths, groups)
    sizes = groups.groupBy("plate_group").agg(F.count("*").alias("group_size"))
    per = joined.groupBy("truth").agg(F.count("*").alias("sightings"), F.count("plate_group").alias("read"), F.count_distinct("plate_group").alias("clusters"), F.min("plate_group").alias("plate_group"), (F.max("t") - F.min("t")).alias("true_dwell")).filter("sightings >= 2")
    per = per.join(sizes, "plate_group", "left").join(ocr.select("plate_group", F.col("dwell").alias("__dwell")), "plate_group", "left")
    same = (F.col("read") == F.col("sightings")) & (F.col("group_size") == F.col("sightings"))
    status = F.when(F.col("clusters") == 0, "dropped").when(F.col("clusters") > 1, "split").when(same, "exact").otherwise("corrupted")
    single = F.col("clusters") == 1
    return per.select("truth", "sightings", "clusters", status.alias("status"), "true_dwell", F.when(single, F.col("__dwell")).alias("ocr_dwell"))


def ordered_crossings(crossings: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return crossings.orderBy(rank, "truth")


def split_fragments(joined: DataFrame, crossings: DataFrame) -> DataFrame:
    """Texts seen on split crossings. joined: truth, plate_text."""
    split = crossings.filter("status = 'split'").select("truth")
    return joined.join(split, "truth", "left_semi").filter("plate_text is not null").select("plate_text").distinct()


def crossing_status_summary(crossings: DataFrame, least_dwell: float) -> DataFrame:
    """Counts by status, the mean error of corrupted ones that dwelt long enough, and how many were left out of it."""
    long = F.col("true_dwell") >= least_dwell
    corrupted = (F.col("status") == "corrupted") & F.col("ocr_dwell").isNotNull()
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    delta = F.avg(F.when(corrupted & long, F.abs(F.col("ocr_dwell") - F.col("true_dwell")))).alias("mean_abs_delta")
    return crossings.agg(*counts, delta, F.count_if(corrupted & ~long).alias("excluded"))


def dwell_accuracy(crossings: DataFrame, least_dwell: float, tolerance: float) -> DataFrame:
    """bucket, n, share and within (the share of all that is within tolerance) of relative errors."""
    own = crossings.filter((F.col("ocr_dwell").isNotNull()) & (F.col("true_dwell") > 0) & (F.col("true_dwell") >= least_dwell))
    own = own.withColumn("e", F.abs(F.col("ocr_dwell") - F.col("true_dwell")) / F.col("true_dwell"))
    total = own.agg(F.count("*").alias("total"), F.count_if(F.col("e") <= tolerance).alias("near"))
    return own.groupBy(relative_error_bucket(F.col("e")).alias("bucket")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("bucket", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("near") / F.col("total")).alias("within"))


def mean_median_dwell(matches: DataFrame) -> DataFrame:
    own = matches.filter(F.coalesce("counted", F.lit(True)))
    middle = exact_quantiles(own, [], "dwell", {"median_dwell": 0.5})
    return own.agg(F.coalesce(F.avg("dwell"), F.lit(0.0)).alias("mean_dwell")).join(middle, how="left").fillna(0.0, ["median_dwell"])


def _ocr_measures() -> list[Column]:
    usable = F.col("truth").isNotNull() & (F.col("truth") != "")
    scored = usable & ~F.col("missing")
    edits = F.when(scored, F.levenshtein("truth", F.coalesce("plate_text", F.lit(""))))
    length = F.when(scored, F.length("truth"))
    n, exact = F.count_if(scored), F.count_if(scored & F.col("truth").eqNullSafe(F.col("plate_text")))
    return [F.count("*").alias("entries"), F.count_if(~scored).alias("thrown_out"), n.alias("evaluated"), F.count_distinct(F.when(usable, F.col("truth"))).alias("unique_plates"), exact.alias("exact_matches"), F.when(n > 0, exact / n).alias("match_rate"), F.when(F.sum(length) > 0, 1 - F.sum(edits) / F.sum(length)).alias("char_accuracy")]


def ocr_accuracy(rows: DataFrame) -> DataFrame:
    """For rows(truth, plate_text, missing: the picture isn't there)."""
    return rows.agg(*_ocr_measures())


def ocr_accuracy_by_video(rows: DataFrame) -> DataFrame:
    """As ocr_accuracy by video; plates of missing pictures aren't counted as seen there."""
    return rows.withColumn("truth", F.when(~F.col("missing"), F.col("truth"))).groupBy("video").agg(*_ocr_measures())


def miss_distances(rows: DataFrame) -> DataFrame:
    """bucket, n, share for readings(truth, plate_text) that aren't exact, with mean and median edit distance."""
    d = rows.filter("truth is not null and truth <> ''").withColumn("d", F.levenshtein("truth", F.coalesce("plate_text", F.lit("")))).filter("d > 0")
    every = d.agg(F.count("*").alias("total"), F.avg("d").alias("mean_distance")).join(exact_quantiles(d, [], "d", {"median_distance": 0.5}), how="left")
    buckets = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in ("1", "2", "3", "4+")])).alias("bucket"))
    n = d.groupBy(miss_bucket(F.col("d")).alias("bucket")).agg(F.count("*").alias("n"))
    out = buckets.join(n, "bucket", "left").crossJoin(F.broadcast(every))
    n = F.coalesce("n", F.lit(0))
    return out.select("bucket", n.alias("n"), F.when(F.col("total") > 0, n / F.col("total")).alias("share"), "mean_distance", "median_distance")


def extraction_stats(manifest: DataFrame) -> DataFrame:
    """How many plate pictures were cut out of how many videos: manifest(img_path, source_video)."""
    return manifest.agg(F.count_distinct("source_video").alias("videos"), F.count_distinct("img_path").alias("plates"))


def dwell_report_stats(readings: DataFrame, matches: DataFrame) -> DataFrame:
    """How many pictures, readable plates, matches and single sightings."""
    a = readings.agg(F.count("*").alias("images"), F.count("plate_text").alias("plates_read"), F.count_distinct("plate_text").alias("texts"))
    return a.crossJoin(F.broadcast(matches.agg(F.count("*").alias("matched"), F.coalesce(F.sum("sightings"), F.lit(0)).alias("matched_sightings")))).withColumn("single_sightings", F.col("plates_read") - F.col("matched_sightings"))
