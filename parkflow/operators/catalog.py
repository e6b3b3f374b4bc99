"""Images, entities and their instances: joins, exports and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkflow.functions import clock, labels



def entity_sightings(entities: DataFrame, instances: DataFrame, images: DataFrame) -> DataFrame:
    return entities.join(instances, "entity_id").join(images, "image_id")


def image_entities(instances: DataFrame, entities: DataFrame) -> DataFrame:
    return instances.select("image_id", "entity_id").join(entities, "entity_id")


def image_left_instances(images: DataFrame, instances: DataFrame, type_id: int) -> DataFrame:
    """All images, with their instances of one type where there are any."""
    return images.join(instances.filter(F.col("type_id") == type_id), "image_id", "left")


def cluster_members(entities: DataFrame, compat: bool = False) -> DataFrame:
    """entity_id, cluster and mates (how many others its cluster has): who belongs together, without listing pairs.
    compat: those without a cluster are mates too; else they have none."""
    sizes = entities.groupBy("cluster").agg((F.count("*") - 1).alias("mates"))
    same = entities.join(sizes.withColumnRenamed("cluster", "of"), F.col("cluster").eqNullSafe(F.col("of"))).drop("of")
    return same.select("entity_id", "cluster", F.when(F.col("cluster").isNull() & F.lit(not compat), 0).otherwise(F.col("mates")).alias("mates"))


def cluster_mates(entities: DataFrame, compat: bool = False, of: DataFrame | None = None, block: int = 2048) -> DataFrame:
    """Pairs of different entities of one cluster. compat: those without one are mates too. of: the entity_ids whose
    mates are asked for; all pairs of all clusters grow with the square of a cluster, see cluster_members.

    Both sides of a cluster are cut into blocks of about `block`, and pairs of blocks are dealt among as many tasks as
    their pairs need: the rows that come in are too few to tell how many go out, and a large cluster isn't one task."""
    known = entities.select("entity_id", F.coalesce(F.col("cluster").cast("string"), F.lit("")).alias("k"), F.col("cluster").isNull().alias("none"))
    known = known if compat else known.filter("not none")
    asked = known if of is None else known.join(of, "entity_id", "left_semi")
    sizes = known.groupBy("k", "none").agg(F.count("*").alias("n"))
    pairs = asked.groupBy("k", "none").count().join(sizes, ["k", "none"]).agg(F.sum(F.col("count").cast("double") * F.col("n"))).first()[0] or 0.0
    tasks = int(min(1 + pairs // block**2, 10_000))
    blocks = sizes.select("k", "none", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own, every = F.pmod(F.xxhash64("entity_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    keys = ["k", "none", "left", "right"]
    a = asked.join(blocks, ["k", "none"]).select("entity_id", "k", "none", own.alias("left"), every.alias("right")).repartition(tasks, *keys)
    b = known.join(blocks, ["k", "none"]).select(F.col("entity_id").alias("mate_id"), "k", "none", every.alias("left"), own.alias("right")).repartition(tasks, *keys)
    return a.join(b.hint("merge"), keys).filter("entity_id <> mate_id").select("entity_id", "mate_id")


def unseen_paths(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    return listing.join(catalog, "path", "left_anti")


def import_new(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """The catalog with the paths it didn't have, once each."""
    return catalog.select("path").unionByName(unseen_paths(listing.select("path"), catalog).distinct())


def images_of_entities(instances: DataFrame, entity_ids: DataFrame) -> DataFrame:
    return instances.join(entity_ids, "entity_id", "left_semi").select("image_id").distinct()


def present_types(instances: DataFrame) -> DataFrame:
    return instances.select("type_id").distinct()


def first_in_bucket(instances: DataFrame, *bucket: str) -> DataFrame:
    """One instance of each entity in each bucket, its first by time and image."""
    w = Window.partitionBy(*bucket, "entity_id").orderBy("epoch_s", "image_id")
    return instances.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def counts_per_interval(images: DataFrame, instances: DataFrame, entities: DataFrame, minutes: int, types: dict[int, str], directions: bool = False) -> DataFrame:
    """A row for each interval with images (0: for each image time): entities of each type, each counted once, and the
    clusters among them (those without one are a cluster per image). Intervals begin anew each hour.

    directions: a column per type and direction instead; one instance may count for a side and for a way.
    """
    rows = images.select("image_id", "epoch_s", clock.interval_floor(F.col("epoch_s"), minutes).alias("bucket"))
    seen = first_in_bucket(instances.join(rows, "image_id"), "bucket").join(entities.select("entity_id", "cluster"), "entity_id", "left")

    def count(test: Column, name: str) -> Column:
        return F.count_if(test).alias(name)

    columns = []
    for i, name in types.items():
        own = F.col("type_id") == i
        if directions:
            sides = {"left": F.col("direction_lr") == -1, "right": F.col("direction_lr") == 1, "forward": F.col("direction_fb") == 1, "back": F.col("direction_fb") == -1}
            columns += [count(own & test, f"{name} count - {side}") for side, test in sides.items()]
        else:
            columns.append(count(own, f"{name} count"))
    loose = F.count_distinct(F.when(F.col("cluster").isNull(), F.col("image_id")))
    counted = seen.groupBy("bucket").agg(*columns, (F.count_distinct("cluster") + loose).alias("cluster count"))
    every = rows.select("bucket").distinct()
    return every.join(counted, "bucket", "left").fillna(0)


def counts_per_image(images: DataFrame, instances: DataFrame, entities: DataFrame, types: dict[int, str], directions: bool = False) -> DataFrame:
    return counts_per_interval(images, instances, entities, 0, types, directions)


def entity_span(sightings: DataFrame) -> DataFrame:
    """Seconds between first and last image of each entity."""
    return sightings.groupBy("entity_id").agg((F.max("epoch_s") - F.min("epoch_s")).alias("span_s"))


def _round(x: Column) -> Column:
    return F.bround(x, 4)


def entity_rollup(entities: DataFrame, instances: DataFrame, images: DataFrame, speed: str = "speed") -> DataFrame:
    """First and last time, dwell, cluster size, type and directions (of the first image) and speed of each entity."""
    seen = instances.join(images.select("image_id", "epoch_s"), "image_id").groupBy("entity_id").agg(F.min("epoch_s").alias("first_s"), F.max("epoch_s").alias("last_s"), F.min(F.struct("image_id", "type_id", "direction_lr", "direction_fb")).alias("f"))
    sizes = entities.filter("cluster is not null").groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    side, way = labels.direction_words(F.col("f.direction_lr"), F.col("f.direction_fb"))
    df = entities.join(seen, "entity_id").join(sizes, "cluster", "left")
    dwell = F.col("last_s") - F.col("first_s")
    return df.select("entity_id", "first_s", "last_s", dwell.alias("dwell_s"), clock.format_hms(dwell).alias("dwell"), labels.class_label(F.col("f.type_id")).alias("type"), F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"), side.alias("left_right"), way.alias("forward_back"), _round(F.col(speed)).alias("speed"))


def cluster_rollup(entities: DataFrame, instances: DataFrame, images: DataFrame, compat: bool = False) -> DataFrame:
    """First and last time, dwell and size of each cluster. compat: the end is the least of the members' last times,
    and those without a cluster are one."""
    seen = instances.join(images.select("image_id", "epoch_s"), "image_id").groupBy("entity_id").agg(F.min("epoch_s").alias("first_s"), F.max("epoch_s").alias("last_s"))
    df = entities.join(seen, "entity_id")
    df = df if compat else df.filter("cluster is not null")
    end = F.min("last_s") if compat else F.max("last_s")
    out = df.groupBy("cluster").agg(F.min("first_s").alias("first_s"), end.alias("end_s"), F.count("*").alias("size"))
    return out.withColumn("dwell_s", F.col("end_s") - F.col("first_s")).withColumn("dwell", clock.format_hms(F.col("dwell_s")))


def sorted_gallery(ids: DataFrame, order: str) -> DataFrame:
    return ids.distinct().orderBy(order)


def page(df: DataFrame, order: list[str], start: int = 0, rows: int = 300) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(rows)


def earliest_image(images: DataFrame) -> DataFrame:
    return images.orderBy("epoch_s", "image_id").limit(1)


def latest_image(images: DataFrame) -> DataFrame:
    return images.orderBy(F.col("epoch_s").desc(), "image_id").limit(1)


def entity_earliest_latest(sightings: DataFrame) -> DataFrame:
    by = F.struct("epoch_s", "image_id")
    return sightings.groupBy("entity_id").agg(F.min(by)["image_id"].alias("earliest"), F.max(by)["image_id"].alias("latest"))


def replace_analysis(entities: DataFrame, instances: DataFrame, images: DataFrame, done: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, instances and images after the images in `done` were analysed again: their instances give way to
    `new` (image_id, type_id, box, confidence), with an entity for each box, named by a hash of image and box."""
    boxes = new.withColumn("entity_id", F.xxhash64("image_id", "type_id", "x", "y", "width", "height"))
    kept = instances.join(done, "image_id", "left_anti").unionByName(boxes, allowMissingColumns=True)
    every = entities.unionByName(boxes.select("entity_id").distinct(), allowMissingColumns=True)
    marked = images.join(done.select("image_id", F.lit(True).alias("__done")), "image_id", "left").withColumn("analyzed", F.coalesce("__done", "analyzed")).drop("__done")
    return drop_orphan_entities(every, kept), kept, marked


def frames_to_images(detections: DataFrame, start_s: Column, fps: float, compat: bool = False) -> DataFrame:
    """An image row for each frame with detections. compat: whole frames a second only."""
    rate = float(int(fps)) if compat else fps
    path = F.concat("video", F.lit("-frames/"), F.col("frame_index").cast("string"), F.lit(".jpg"))
    df = detections.select("video", "frame_index").distinct()
    return df.select(F.xxhash64("video", "frame_index").alias("image_id"), path.alias("path"), clock.frame_time(start_s, F.col("frame_index"), F.lit(rate)).alias("epoch_s"))


def cascade_delete(instances: DataFrame, images: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Instances without those of deleted images or entities."""
    df = instances if images is None else instances.join(images, "image_id", "left_anti")
    return df if entities is None else df.join(entities, "entity_id", "left_anti")


def drop_orphan_entities(entities: DataFrame, instances: DataFrame) -> DataFrame:
    return entities.join(instances, "entity_id", "left_semi")


def reassign_entities(entities: DataFrame, instances: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move instances by mapping(old_id, new_id) and drop the entities that are left without any."""
    moved = instances.join(mapping, F.col("entity_id") == F.col("old_id"), "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("old_id", "new_id")
    return drop_orphan_entities(entities, moved), moved


def set_columns(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Write analysis results back: values' columns replace df's where the key has a row."""
    names = [c for c in values.columns if c != key]
    new = values.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    return df.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in names}).drop(*[f"__{c}" for c in names])


def set_direction(instances: DataFrame, poses: DataFrame, types: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The first pose result of each instance of a type that has poses. poses: image_id, entity_id, pose, direction_lr, direction_fb."""
    first = poses.groupBy("image_id", "entity_id").agg(F.min(F.struct("pose", "direction_lr", "direction_fb")).alias("p"))
    df = instances.join(first, ["image_id", "entity_id"], "left")
    own = F.col("p").isNotNull() & F.col("type_id").isin(*types)
    return df.withColumns({c: F.when(own, F.col(f"p.{c}")).otherwise(F.col(c)) for c in ("direction_lr", "direction_fb")}).drop("p")


