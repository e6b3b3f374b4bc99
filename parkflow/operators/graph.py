"""Connected components, and groups of boxes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkflow.functions.geometry import Box, boxes_close, similar_size, union_box_agg
from parkflow.tables import dropped, written


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) for nodes(id) and edges(a, b); repeated nodes and edges count once.

    Large-star and small-star steps in turn (Kiveris et al., Connected Components in MapReduce and Beyond), each a join
    and a grouped minimum on the edges, until every node has one edge, to its least. A round's table replaces that of
    the round before.
    """
    links = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        dropped(links)
        links = after
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    root = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return nodes.select("id").distinct().join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def close_pairs(boxes: DataFrame, distance: int = 60, ratio: float = 2.5, compat: bool = False, cell: int = 256) -> DataFrame:
    """image_id, a, b: pairs of boxes(image_id, idx, x, y, w, h) of one image that are close and similar in size.

    Boxes meet in upright strips of the image, `cell` pixels wide: each enters those that it or its surroundings touch,
    and a pair counts in the first strip that both are in.
    """
    strip = lambda x: F.floor(x / cell).cast("long")
    dealt = boxes.withColumn("__first", strip(F.col("x"))).withColumn("__strip", F.explode(F.sequence("__first", F.greatest("__first", strip(F.col("x") + F.col("w") + distance)))))
    a, b = dealt.alias("a"), dealt.alias("b")
    p, q = (Box(*(F.col(f"{s}.{c}") for c in "xywh")) for s in "ab")
    meet = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.__strip") == F.col("b.__strip")) & (F.col("a.idx") < F.col("b.idx"))
    once = F.col("a.__strip") == F.greatest("a.__first", "b.__first")
    return a.join(b, meet & once & boxes_close(p, q, distance, compat) & similar_size(p, q, ratio)).select(F.col("a.image_id").alias("image_id"), F.col("a.idx").alias("a"), F.col("b.idx").alias("b"))


def _components_of_image(distance: float, ratio: float, block: int = 64) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """idx and cluster of the boxes of an image that aren't the least of their group. Each box is compared once, with the
    boxes in reach of x that no group has yet; pairs aren't kept."""

    def groups(boxes: pd.DataFrame) -> pd.DataFrame:
        boxes = boxes.sort_values("x", kind="stable")
        ids = boxes["idx"].to_numpy("int64")
        x, y, w, h = (boxes[c].to_numpy(float) for c in "xywh")
        area, right, low = w * h, x + w + distance, y + h + distance
        free, cluster, wide = area > 0, ids.copy(), max(w.max(), 0) + distance
        for first in np.argsort(ids, kind="stable").tolist():
            if not free[first]:
                continue
            free[first], edge = False, np.array([first])
            while len(edge):
                own, edge = edge[:block], edge[block:]
                begin, end = np.searchsorted(x, x[own].min() - wide, side="left"), np.searchsorted(x, right[own].max(), side="right")
                near = begin + np.flatnonzero(free[begin:end])
                a = own[:, None]
                close = (x[a] <= right[near]) & (x[near] <= right[a]) & (y[a] <= low[near]) & (y[near] <= low[a])
                close &= np.maximum(area[a], area[near]) <= ratio * np.minimum(area[a], area[near])
                more = near[close.any(axis=0)]
                free[more], cluster[more] = False, ids[first]
                edge = np.sort(np.concatenate([edge, more]))
        moved = cluster != ids
        return pd.DataFrame({"idx": ids[moved], "cluster": cluster[moved]})

    return groups


def box_clusters(boxes: DataFrame, distance: int = 60, ratio: float = 2.5) -> DataFrame:
    """boxes with cluster: the least idx that close pairs lead to. idx must be unique over all images.

    No pair leaves its image, so the boxes of each image are grouped apart, without listing its close pairs, which grow
    with the square of what it shows.
    """
    own = boxes.select("image_id", "idx", "x", "y", "w", "h").na.drop()
    found = own.groupBy("image_id").applyInPandas(_components_of_image(distance, ratio), "idx long, cluster long")
    return boxes.join(found, "idx", "left").withColumn("cluster", F.coalesce("cluster", "idx"))


def cluster_boxes(clustered: DataFrame) -> DataFrame:
    """Box around each cluster, and its members by class."""
    box = Box(*(F.col(c) for c in "xywh"))
    by_class = clustered.groupBy("image_id", "cluster", "class_id").agg(*union_box_agg(box), F.count("*").alias("n"))
    classes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "n")))).alias("classes")
    return by_class.groupBy("image_id", "cluster").agg(*union_box_agg(box), F.sum("n").alias("n"), classes)


def assign_clusters(entities: DataFrame, clustered: DataFrame) -> DataFrame:
    """Entities with the cluster of their last image. clustered: entity_id, image_id, epoch_s, cluster."""
    last = clustered.groupBy("entity_id").agg(F.max(F.struct("epoch_s", "image_id", "cluster"))["cluster"].alias("__new"))
    return entities.join(last, "entity_id", "left").withColumn("cluster", F.coalesce("__new", "cluster")).drop("__new")


def bike_rider_pairs(detections: DataFrame, k: float) -> DataFrame:
    """image_id, bike, person: riders within reach of a bicycle or motorcycle: from the middle of its upper edge to the
    person's centre it is less than k times half the person's width."""
    bikes = detections.filter("class_id in (1, 3)").select("image_id", F.col("idx").alias("bike"), (F.col("x") + F.col("w") / 2).alias("bx"), F.col("y").alias("by"))
    people = detections.filter("class_id = 0").select("image_id", F.col("idx").alias("person"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"), "w")
    dx, dy = F.col("bx") - F.col("px"), F.col("by") - F.col("py")
    return bikes.join(people, "image_id").filter(dx * dx + dy * dy < (k * F.col("w") / 2) * (k * F.col("w") / 2)).select("image_id", "bike", "person")


def merge_bikes_riders(detections: DataFrame, k: float = 1.0) -> DataFrame:
    """Each person goes to the first bike in reach; the bike's box grows around its riders, who leave the table."""
    taken = bike_rider_pairs(detections, k).groupBy("image_id", "person").agg(F.min("bike").alias("bike"))
    riders = taken.join(detections.withColumnRenamed("idx", "person"), ["image_id", "person"]).select("image_id", F.col("bike").alias("idx"), "x", "y", "w", "h")
    grown = detections.join(taken.select("image_id", F.col("person").alias("idx")), ["image_id", "idx"], "left_anti")
    box = Box(*(F.col(c) for c in "xywh"))
    all_boxes = grown.select("image_id", "idx", "x", "y", "w", "h").unionByName(riders).groupBy("image_id", "idx").agg(*union_box_agg(box))
    return grown.drop("x", "y", "w", "h").join(all_boxes, ["image_id", "idx"])
