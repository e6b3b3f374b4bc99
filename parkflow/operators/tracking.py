"""Tracking and re-identification: folds over time, in groups that can't influence one another.

Only the fold itself is Python; everything before and after is DataFrame code.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkflow.functions.geometry import Box, box_iou, motion_direction, pixel_speed
from parkflow.operators.bundles import Bundles
from parkflow.operators.folds import Fold, fold_in_parts
from parkflow.operators.graph import connected_components
from parkflow.operators.overlap import met
from parkflow.tables import numbered, written


def segment_by_gap(df: DataFrame, keys: list[str], time: str, gap: float, strict: bool = False) -> DataFrame:
    """Adds segment: a new one begins where the time since the row before is at least (strict: more than) gap."""
    w = Window.partitionBy(*keys).orderBy(time)
    since = F.col(time) - F.lag(time).over(w)
    return df.withColumn("segment", F.coalesce(F.sum((since > gap if strict else since >= gap).cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def _stretch(time: str, most: float) -> Column:
    """A number such that times no more than `most` apart, rounding included, have the same or the next one."""
    return F.floor(F.col(time) / F.lit(1.001 * most + 1e-9))


def overlaps(rows: DataFrame, keys: list[str], time: str, most: float, least: float, strict: bool = False, cell: int = 128) -> DataFrame:
    """l, r, time (of r) and iou: pairs of rows(id, *keys, time, x, y, w, h) alike in keys, l before r by no more than
    `most` (strict: by less), whose boxes have an IoU of at least `least` (0: more than 0).

    They meet in cells of space and time: each box enters the cells of the picture that it touches, l in its own stretch
    of time and the next, and a pair counts in the cell where the common part of the two begins.
    """
    across = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.greatest(F.col(size), F.lit(0))) / cell)))
    stretch = _stretch(time, most)
    dealt = rows.withColumn("cell_x", across("x", "w")).withColumn("cell_y", across("y", "h"))
    a = dealt.withColumn("stretch", F.explode(F.array(stretch, stretch + 1))).alias("a")
    b = dealt.withColumn("stretch", stretch).alias("b")
    p, q = (Box(*(F.col(f"{s}.{c}") for c in "xywh")) for s in "ab")
    meet = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "stretch", "cell_x", "cell_y")])
    since = F.col(f"b.{time}") - F.col(f"a.{time}")
    once = (F.col("a.cell_x") == F.floor(F.greatest(p.x, q.x) / cell)) & (F.col("a.cell_y") == F.floor(F.greatest(p.y, q.y) / cell))
    near = (since > 0) & (since < most if strict else since <= most)
    found = a.join(b, meet & near & once).select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), F.col(f"b.{time}").alias("time"), box_iou(p, q).alias("iou"))
    return found.filter(F.col("iou") >= least if least > 0 else F.col("iou") > 0)


def iou_candidates(detections: DataFrame, alive: int, least: float = 0.15) -> DataFrame:
    """l, r, time (r's frame) and iou of the detections(id, video, frame_index, x, y, w, h) of a video that a track could
    link: l may be the last box of a live track when r comes."""
    return overlaps(detections, ["video"], "frame_index", alive, least)


def taken_in_order(i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The places of the pairs (i, k), in the order in which they stand, of which neither end is taken yet."""
    at, out = np.arange(len(i)), []
    first_i, first_k = (np.empty(v.max(initial=-1) + 1, int) for v in (i, k))
    while len(at):
        first_i[i[at[::-1]]], first_k[k[at[::-1]]] = at[::-1], at[::-1]
        sure = at[(first_i[i[at]] == at) & (first_k[k[at]] == at)]
        out.append(sure)
        gone_i, gone_k = np.zeros(len(first_i), bool), np.zeros(len(first_k), bool)
        gone_i[i[sure]] = gone_k[k[sure]] = True
        at = at[~(gone_i[i[at]] | gone_k[k[at]])]
    return np.concatenate(out) if out else at


def _followed(time: str, most: float, least: float, strict: bool, in_turn: bool) -> Fold:
    """id and head of the boxes(id, time, x, y, w, h) of one part: the first of its chain in this part, or the box that the
    chain came in with. Handed on are the boxes that end a chain, in the order in which the chains began. in_turn: boxes
    choose one after the other, by id; else those of a time that overlap most go together first."""

    def fold(rows: pd.DataFrame, came: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
        rows = rows.sort_values("id")
        ids, times, boxes = rows["id"].to_numpy("int64"), rows[time].to_numpy(float), rows[["x", "y", "w", "h"]].to_numpy(float)
        n = len(came[0]) if came else 0
        live_id, live_t, live_box = came if came else (ids[:0], times[:0], boxes[:0])
        begun, live_head = np.arange(-n, 0), live_id  # chains by the order in which they began
        heads = ids.copy()
        at = 0
        while at < len(ids):
            end = at + int(np.searchsorted(times[at:], times[at], side="right"))
            since = times[at] - live_t
            stays = since < most if strict else since <= most
            live_id, live_t, live_box, begun, live_head = (v[stays] for v in (live_id, live_t, live_box, begun, live_head))
            i, k, iou = met(live_box, boxes[at:end], least)
            order = np.lexsort((begun[k], -iou, i) if in_turn else (begun[k], i, -iou))
            i, k = i[order], k[order]
            took = taken_in_order(i, k)
            i, k = i[took], k[took]
            heads[at + i] = live_head[k]
            own_begun = np.arange(at, end)
            own_begun[i] = begun[k]
            left = np.ones(len(live_id), bool)
            left[k] = False
            live_id, live_t, live_box, begun, live_head = (np.concatenate([v[left], w]) for v, w in ((live_id, ids[at:end]), (live_t, times[at:end]), (live_box, boxes[at:end]), (begun, own_begun), (live_head, heads[at:end])))
            at = end
        order = np.argsort(begun)
        stays = order[(times[-1] - live_t[order]) <= most]
        return pd.DataFrame({"id": ids, "head": heads}), [live_id[stays], live_t[stays], live_box[stays]]

    return fold


def followed(rows: DataFrame, group: str, time: str, most: float, least: float, strict: bool = False, in_turn: bool = False, each: int = 250_000) -> DataFrame:
    """id and chain (its first id) of the boxes rows(id, group, time, x, y, w, h), ids in the order of time: each box
    continues a chain of its group whose last box it overlaps, at most `most` before (strict: less), or begins one (see
    _followed). Equal overlaps are in the order of the boxes, then in that in which the chains began.

    Gone through in parts of about `each` boxes (see fold_in_parts), never as all pairs that overlap, which grow with the
    square of what is seen at a time. No part is shorter than `most`, so that nothing reaches over one.
    """
    columns = ["id", group, time, "x", "y", "w", "h"]
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    n, low, high, groups = rows.filter(whole).agg(F.count("*"), F.min(time), F.max(time), F.count_distinct(group)).first()
    if not n:
        return rows.select("id", F.col("id").alias("chain"))
    long = max(1.001 * most + 1e-9, (high - low) * each * groups / n)
    dealt = rows.filter(whole).select(*columns).withColumn("part", F.floor((F.col(time) - F.lit(low)) / F.lit(float(long))))
    found = written(fold_in_parts(dealt, group, _followed(time, most, least, strict, in_turn), "id long, head long"))
    came = found.join(found.filter("id <> head").select(F.col("head").alias("id")).distinct(), "id", "left_semi").filter("id <> head")
    links = came.select(F.col("head").alias("a"), F.col("id").alias("b"))
    more = connected_components(links.select(F.explode(F.array("a", "b")).alias("id")), links).select(F.col("id").alias("head"), F.col("component").alias("first"))
    chains = found.join(more, "head", "left").select("id", F.coalesce("first", "head").alias("chain"))
    return chains.unionByName(rows.filter(~whole).select("id", F.col("id").alias("chain")))


def iou_by_frame(detections: DataFrame, alive: int, least: float = 0.15) -> DataFrame:
    """time, n and iou (a sum) of the iou_candidates by r's frame. Equal boxes of a frame meet others once and count as
    often as they are, so that copies aren't expanded into pairs."""
    alike = detections.groupBy("video", "frame_index", "x", "y", "w", "h").agg(F.count("*").alias("n"))
    alike = written(alike.withColumn("id", F.struct("x", "y", "w", "h", "n")))
    found = iou_candidates(alike, alive, least).withColumn("many", F.col("l.n") * F.col("r.n"))
    return found.groupBy("time").agg(F.sum("many").alias("n"), F.sum(F.col("iou") * F.col("many")).alias("iou"))


def _ranked(chains: DataFrame, key: str) -> DataFrame:
    """chain and number: the chains(chain, key) of each key, from 1, in the order of their first ids."""
    begun = numbered(chains.select("chain", key).distinct(), [key, "chain"], "at")
    first = begun.groupBy(key).agg(F.min("at").alias("from"))
    return begun.join(first, key).select("chain", (F.col("at") - F.col("from") + 1).alias("number"))


#: Tracks that came into a part are numbered from here on, in the order in which they began; those of the part from 0 on.
CAME = -(2**62)


def _bundled(group: str, time: str, most: float, least: float) -> Fold:
    """Which tracks have the boxes(id, group, part, time, x, y, w, h, n) of one part: the copies of id from the at-th on, n
    of them, go on with the tracks from `head` on. Rows with id -1 are the tracks handed on, the at-th and those behind it.
    Handed on are only boxes, times and how many, in the order in which the tracks began: what another part hangs on."""

    def fold(rows: pd.DataFrame, came: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
        rows = rows.sort_values([time, "x", "y", "w", "h"], kind="stable")
        ids, times, boxes, many = rows["id"].tolist(), rows[time].to_numpy(float), rows[["x", "y", "w", "h"]].to_numpy(float), rows["n"].tolist()
        n, at, box = came if came else (np.empty(0, "int64"), np.empty((0, 1)), np.empty((0, 4)))
        live = Bundles.of(box, at, list(zip((CAME + np.cumsum(n) - n).tolist(), n.tolist())))
        found, new = [array("q") for _ in range(4)], 0

        def add(own: int, pieces: list[tuple]) -> None:
            at = 0
            for head, n in pieces:
                for column, value in zip(found, (own, at, head, n)):
                    column.append(value)
                at += n

        ends = [*(np.flatnonzero(times[1:] != times[:-1]) + 1).tolist(), len(times)]
        for begin, end in zip([0, *ends], ends):
            live.leave(times[begin] - live.at[:, 0] <= most)
            given, new = live.follow(boxes[begin:end], times[begin : begin + 1], many[begin:end], least, new)
            for own, pieces in zip(ids[begin:end], given):
                add(own, pieces)
        live.leave(times[-1] - live.at[:, 0] <= most)
        box, at, pieces = live.single()
        add(-1, pieces)
        n = np.array([p[1] for p in pieces], "int64")
        fresh = np.flatnonzero(np.append(True, (box[1:] != box[:-1]).any(axis=1) | (at[1:] != at[:-1]).any(axis=1))) if len(n) else n
        columns = dict(zip(("id", "at", "head", "n"), (np.frombuffer(c, "int64") for c in found)))
        handed = [np.add.reduceat(n, fresh) if len(n) else n, at[fresh], box[fresh]]
        return pd.DataFrame(columns).assign(**{group: rows[group].iloc[0], "part": rows["part"].iloc[0]}), handed

    return fold


def _begun(found: DataFrame, group: str) -> DataFrame:
    """group, part, id, at, n and head of the boxes that _bundled finds: the number of the first of their tracks among those
    that began in `part`, which is the boxes' own or an earlier one."""
    own = found.filter("id >= 0")
    if own.filter("head < 0").isEmpty():
        return own
    each = lambda df, offset: df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(group, "part", "id", (F.col("at") + F.col("i")).alias("at"), (F.col("head") + F.col("i") - F.when(F.col("head") < 0, F.lit(CAME)).otherwise(0)).alias("head"), (F.col("head") < 0).alias("came"))
    node = lambda part, at: F.struct(F.col(group).alias("group"), part.alias("part"), F.col(at).alias("at"))
    before = F.col("part") - 1
    handed = written(each(found.filter("id < 0"), CAME))
    links = handed.filter("came").select(node(F.col("part"), "at").alias("a"), node(before, "head").alias("b"))
    first = connected_components(handed.select(node(F.col("part"), "at").alias("id")), links)
    heads = handed.filter("not came").select(node(F.col("part"), "at").alias("component"), F.col("part").alias("__part"), F.col("head").alias("__head"))
    known = written(first.join(heads, "component").select("id", "__part", "__head"))
    later = each(own.filter("head < 0"), CAME).withColumn("__id", node(before, "head")).join(known.withColumnRenamed("id", "__id"), "__id")
    later = later.select(group, F.col("__part").alias("part"), "id", "at", F.col("__head").alias("head"), F.lit(1).cast("long").alias("n"))
    return own.filter("head >= 0").select(later.columns).unionByName(later)


def track_frames(detections: DataFrame, iou: float = 0.15, lost_s: float = 2.0, fps: float = 30.0, each: int = 250_000) -> DataFrame:
    """detections(video, frame_index, x, y, w, h, class_id) with track_id, from 1 within each video.

    In each frame the detections and live tracks that overlap most go together first, one to one; a detection that is
    left begins a track; a track that none follows for lost_s ends. Equal overlaps are in the order of the detections
    (by x, y, w, h, class_id), then in that in which the tracks began. Without a video or frame each is a track.

    Equal boxes of a frame go through as one row and their tracks together (see Bundles). A video is gone through in parts
    of about `each` different boxes (see fold_in_parts), so that none, long or busy as it may be, is one task; no part is
    shorter than lost_s, so that nothing reaches over one.
    """
    most, box = int(fps * lost_s), ["x", "y", "w", "h"]
    same = ["video", "frame_index", *box]
    kinds = detections.groupBy(*same, "class_id").agg(F.count("*").alias("__n"))
    alike = kinds.groupBy(*same).agg(F.sum("__n").alias("n"), F.array_sort(F.collect_list(F.struct("class_id", "__n"))).alias("kinds"))
    rows = written(alike.withColumn("id", F.monotonically_increasing_id()))
    timed = F.col("video").isNotNull() & F.col("frame_index").isNotNull()
    n, low, high, videos = rows.filter(timed).agg(F.count("*"), F.min("frame_index"), F.max("frame_index"), F.count_distinct("video")).first()
    long = max(1.001 * most + 1e-9, (high - low) * each * videos / n) if n else 1.0
    boxes = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(c) for c in box]  # nulls are first in order, and meet none
    dealt = rows.filter(timed).select("id", "video", "frame_index", *boxes, "n", F.floor((F.col("frame_index") - F.lit(low or 0)) / F.lit(float(long))).alias("part"))
    video = rows.schema["video"].dataType.simpleString()
    found = written(fold_in_parts(dealt, "video", _bundled("video", "frame_index", most, iou), f"video {video}, part long, id long, at long, head long, n long"))

    loose = written(numbered(rows.filter(~timed).select(*same, "id", F.col("n").alias("many")), same, sums=("many",)))
    before = loose.groupBy(F.col("video").alias("of")).agg(F.min("before_many").alias("before"), F.sum("many").alias("loose"))
    loose = loose.join(before, F.col("video").eqNullSafe(F.col("of"))).select("id", F.lit(0).cast("long").alias("at"), F.col("many").alias("n"), (F.col("before_many") - F.col("before") + 1).alias("track_id"))
    begun = found.filter("id >= 0 and head >= 0").groupBy("video", "part").agg(F.max(F.col("head") + F.col("n")).alias("begun"))
    ahead = F.coalesce(F.sum("begun").over(Window.partitionBy("video").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = begun.select("video", "part", ahead.alias("ahead")).join(before.select(F.col("of").alias("video"), "loose"), "video", "left")
    tracks = _begun(found, "video").join(begun, ["video", "part"]).select("id", "at", "n", (F.col("ahead") + F.coalesce("loose", F.lit(0)) + F.col("head") + 1).alias("track_id"))

    upto = F.transform("kinds", lambda k, i: F.struct(k["class_id"].alias("class_id"), k["__n"].alias("own"), F.aggregate(F.slice("kinds", 1, i + 1), F.lit(0).cast("long"), lambda s, e: s + e["__n"]).alias("upto")))
    pieces = rows.select("id", *same, F.explode(upto).alias("kind")).join(tracks.unionByName(loose), "id")
    begin, end = F.greatest("at", F.col("kind.upto") - F.col("kind.own")), F.least(F.col("at") + F.col("n"), F.col("kind.upto"))
    # One row for each copy, by way of stretches of them, so that no list is long.
    pieces = pieces.withColumn("begin", begin).withColumn("end", end).filter("begin < end")
    pieces = pieces.withColumn("from", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(65_536).cast("long"))))
    pieces = pieces.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + 65_535, F.col("end") - 1))))
    return pieces.select(*same, F.col("kind.class_id").alias("class_id"), (F.col("track_id") + F.col("copy") - F.col("at")).alias("track_id"))


def track_catalog(instances: DataFrame, images: DataFrame, gap: float = 1.0) -> DataFrame:
    """image_id, entity_id and new_id: over the images in order of time, each instance (by image and entity) continues
    the track of its own type that it overlaps most and that no other took at this time, if the last sighting is less
    than gap ago; of equal overlaps the track that began first. Gone through in parts, as in track_frames.
    """
    cols = ["image_id", "entity_id", "type_id", "x", "y", "width", "height", "epoch_s"]
    rows = instances.join(images.select("image_id", "epoch_s"), "image_id").select(*cols)
    rows = written(numbered(rows, ["epoch_s", "image_id", "entity_id", *cols[2:7]], "id"))
    boxes = rows.withColumnsRenamed({"width": "w", "height": "h"})
    chains = followed(boxes, "type_id", "epoch_s", gap, 0.0, strict=True, in_turn=True)
    first = rows.select(F.col("id").alias("chain"), F.col("entity_id").alias("new_id"))
    return rows.join(chains, "id").join(first, "chain").select(*cols[:2], *cols[2:], "new_id")


def track_motion(tracked: DataFrame, compat: bool = False) -> DataFrame:
    """speed (pixels a second, horizontal) and direction_lr of each track, from its first and last box. compat: the
    last instance doesn't count."""
    w = Window.partitionBy("new_id").orderBy(F.col("epoch_s").desc(), F.col("image_id").desc())
    own = tracked.withColumn("__r", F.row_number().over(w)).filter("__r > 1") if compat else tracked
    box = F.struct("epoch_s", "image_id", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"))
    ends = own.groupBy("new_id").agg(F.min(box).alias("first"), F.max(box).alias("last"), F.count("*").alias("n"))
    a, b = (Box(*(F.col(f"{s}.{c}") for c in "xywh")) for s in ("first", "last"))
    seconds = F.col("last.epoch_s") - F.col("first.epoch_s")
    way = F.when(motion_direction(a, b, tie="left") == "right", 1).otherwise(-1)
    return ends.select(F.col("new_id").alias("entity_id"), "n", pixel_speed(a, b, seconds, horizontal=True).alias("raw_speed"), F.when(F.col("n") > 1, way).alias("direction_lr"))


def similarity_candidates(detections: DataFrame, gallery: DataFrame, similarity: Column, max_gap: float | None = None, block: int = 4096) -> DataFrame:
    """det, entity_id and the best similarity of a detection to each entity's exemplars (of one camera, within
    max_gap). Columns of detections are prefixed d_, those of the gallery g_. With max_gap, rows meet in time buckets of
    one gap and their neighbours only. Without, every detection meets every exemplar of its camera: both sides are cut
    into blocks, and each pair of blocks is dealt apart, so a busy camera isn't one task."""
    on = F.col("d_camera") == F.col("g_camera")
    if max_gap is not None:
        bucket = lambda t: _stretch(t, max_gap)
        detections = detections.withColumn("__d", bucket("d_t"))
        gallery = gallery.withColumn("__g", F.explode(F.array(bucket("g_t") - 1, bucket("g_t"), bucket("g_t") + 1)))
        on = on & (F.col("__d") == F.col("__g")) & (F.abs(F.col("d_t") - F.col("g_t")) <= max_gap)
    else:
        n_d, n_g = (-(-df.count() // block) or 1 for df in (detections, gallery))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        detections = detections.withColumn("__d", part("d_id", n_d)).withColumn("__e", every(n_g))
        gallery = gallery.withColumn("__g", every(n_d)).withColumn("__h", part("g_entity", n_g))
        on = on & (F.col("__d") == F.col("__g")) & (F.col("__e") == F.col("__h"))
    return detections.join(gallery, on).withColumn("__s", similarity).groupBy("d_id", "g_entity").agg(F.max("__s").alias("similarity"))


def best_match(candidates: DataFrame, threshold: float = 0.75, ratio: float = 0.8) -> DataFrame:
    """d_id and g_entity where the best is similar enough and clearly nearer than the second best."""
    w = Window.partitionBy("d_id").orderBy(F.col("similarity").desc(), "g_entity")
    top = candidates.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy("d_id").agg(F.max(F.when(F.col("r") == 1, F.struct("similarity", "g_entity"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("similarity"))).alias("b"))
    far = lambda s: F.greatest(1 - s, F.lit(1e-6))
    clear = F.col("b").isNull() | (F.col("b") <= -1) | (far(F.col("a.similarity")) / far(F.col("b")) <= ratio)
    return top.filter((F.col("a.similarity") >= threshold) & clear).select("d_id", F.col("a.g_entity").alias("g_entity"), F.col("a.similarity").alias("similarity"))


def _nearness(best, other):
    """How near the best match is, against another one; above the ratio it isn't clear."""
    return np.maximum(1 - best, 1e-6) / np.maximum(1 - other, 1e-6)


def _scores(threshold: float, ratio: float, max_gap: float | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """i, j and cosine of the earlier rows j that can decide on row i: its best one in this block, and what is too near it."""

    def unit(rows: pd.DataFrame) -> np.ndarray:
        v = np.stack(rows["feature"].to_numpy()).astype(float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=v, where=norm > 0)

    def block(later: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        if not len(later) or not len(earlier):
            return pd.DataFrame({"i": [], "j": [], "s": []})
        a, b, t_b, id_b, camera_b = unit(later), unit(earlier), earlier["t"].to_numpy(float), earlier["id"].to_numpy(), earlier["camera"].to_numpy()
        out = []
        for at in range(0, len(later), 256):
            own = later.iloc[at : at + 256]
            meets = (own["camera"].to_numpy()[:, None] == camera_b) & (id_b < own["id"].to_numpy()[:, None])
            if max_gap is not None:
                meets &= t_b >= own["t"].to_numpy(float)[:, None] - max_gap
            s = np.where(meets, a[at : at + 256] @ b.T, -2.0)
            top = s.max(axis=1, keepdims=True)
            near = (s > -1) & (_nearness(np.maximum(top, threshold), s) > ratio) | meets & (s == top) & (top >= threshold)
            i, j = np.nonzero(near)
            out.append(pd.DataFrame({"i": own["id"].to_numpy()[i], "j": id_b[j], "s": s[i, j]}))
        return pd.concat(out)

    return block


def _decide(threshold: float, ratio: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One tangle of rows whose decisions hang together: (i, entity) of those that join one, in order of time."""

    def fold(edges: pd.DataFrame) -> pd.DataFrame:
        owner: dict[int, int] = {}
        for i, own in edges.sort_values("i", kind="stable").groupby("i", sort=False):
            best: dict[int, float] = {}
            for head, s in zip(own["head"].tolist(), own["s"].tolist()):
                entity = owner.get(head, head)
                best[entity] = max(best.get(entity, -2.0), s)
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
            if ranked[0][1] >= threshold and (len(ranked) < 2 or _nearness(ranked[0][1], ranked[1][1]) <= ratio):
                owner[i] = ranked[0][0]
        return pd.DataFrame({"i": list(owner), "entity": list(owner.values())}, dtype="int64")

    return fold


def reidentify(profiles: DataFrame, threshold: float = 0.75, ratio: float = 0.8, max_gap: float | None = None, block: int = 1024) -> DataFrame:
    """profiles(camera, profile_id, t, feature) with entity_id: in order of time each joins the best earlier entity (within
    max_gap, where given) if it is similar enough and clearly nearer than the second best, or opens a new one. Ids count
    from 1 in each camera in the order in which they open.

    Cosines are computed block by block, each pair of blocks that can meet in time a task; kept are, for each row, the
    earlier rows that its decision hangs on: the best, and those too near it. With one of them only the row joins it for
    certain, with none it opens an entity. Chains of certain ones are put together; where all that a row hangs on belong
    to one chain it joins that. What is left are small tangles, gone through in order of time by ids and scores. Without
    max_gap each row meets all before it, as the rule says: so many products, but in as many tasks.
    """
    cols = ["camera", "profile_id", "t", "feature"]
    rows = written(numbered(profiles.select(*cols), ["camera", "t", "profile_id"], "id").withColumn("block", F.floor(F.col("id") / block)))
    spans = rows.groupBy("camera", "block").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    stretches = lambda more: F.array(F.lit(0)) if max_gap is None else F.sequence(_stretch("lo", max_gap), _stretch("hi", max_gap) + more)
    a, b = spans.withColumn("stretch", F.explode(stretches(0))).alias("a"), spans.withColumn("stretch", F.explode(stretches(1))).alias("b")
    meet = (F.col("a.camera") == F.col("b.camera")) & (F.col("a.stretch") == F.col("b.stretch")) & (F.col("b.block") <= F.col("a.block"))
    meet = meet if max_gap is None else meet & (F.col("b.hi") >= F.col("a.lo") - max_gap)
    cells = written(a.join(b, meet).select(F.col("a.block").alias("later"), F.col("b.block").alias("earlier")).distinct())
    names = ["later", "earlier", "camera", "id", "t", "feature"]
    side = lambda which: rows.join(cells, F.col("block") == F.col(which)).select(*[F.col(c).alias(c) for c in names]).groupBy("later", "earlier")
    found = written(side("later").cogroup(side("earlier")).applyInPandas(_scores(threshold, ratio, max_gap), "i long, j long, s double"))
    best = found.groupBy("i").agg(F.max("s").alias("top")).filter(F.col("top") >= threshold)
    far = lambda s: F.greatest(1 - F.col(s), F.lit(1e-6))
    near = found.join(best, "i").filter((far("top") / far("s") > ratio) | (F.col("s") == F.col("top"))).select("i", "j", "s")
    near = written(near.withColumn("n", F.count("*").over(Window.partitionBy("i"))))

    owner = written(connected_components(rows.select("id"), near.filter("n = 1").select(F.col("i").alias("a"), F.col("j").alias("b"))))

    def merged(owner: DataFrame, links: DataFrame) -> DataFrame:
        """owner once the rows i of links(i, entity), which no chain led on, have joined those entities."""
        ids = links.select(F.explode(F.array("i", "entity")).alias("id"))
        whole = connected_components(ids, links.select(F.col("i").alias("a"), F.col("entity").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("whole"))
        return written(owner.join(whole, "component", "left").select("id", F.coalesce("whole", "component").alias("component")))

    heads = lambda: near.filter("n > 1").join(owner.select(F.col("id").alias("j"), F.col("component").alias("head")), "j").select("i", "head", "s")
    one = written(heads().groupBy("i").agg(F.min("head").alias("entity"), F.max("head").alias("other")).filter("entity = other").select("i", "entity"))
    owner = merged(owner, one)
    open_ = written(heads().join(one, "i", "left_anti"))
    if not open_.isEmpty():
        ends = open_.select(F.col("i").alias("a"), F.col("head").alias("b"))
        tangle = connected_components(ends.select(F.explode(F.array("a", "b")).alias("id")), ends).select(F.col("id").alias("i"), F.col("component").alias("tangle"))
        owner = merged(owner, written(open_.join(tangle, "i").groupBy("tangle").applyInPandas(_decide(threshold, ratio), "i long, entity long")))
    owned = rows.join(owner.withColumnRenamed("component", "chain"), "id")
    return owned.join(_ranked(owned.filter("id = chain"), "camera").withColumnRenamed("number", "entity_id"), "chain").select(*cols, "entity_id")


def _claims(most: float) -> Fold:
    """Cars of one part in order, and all tracks near them. Tracks of one time are claimed by ascending ids, so what is
    handed on is how many of each time are gone."""

    def fold(rows: pd.DataFrame, came: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
        cars = rows[rows["car_id"].notna()].sort_values(["t", "car_id"], kind="stable")
        tracks = rows[rows["track_id"].notna()].sort_values(["t", "track_id"], kind="stable")
        times, start, size = np.unique(tracks["t"].to_numpy(float), return_index=True, return_counts=True)
        used = np.zeros(len(times), dtype="int64")
        if came:
            at = np.searchsorted(times, came[0])
            known = np.append(times, np.nan)[at] == came[0]
            used[at[known]] = came[1][known]
        ids, times, start, gone, size = (v.tolist() for v in (tracks["track_id"], times, start, used, size))
        n = len(times)
        before, after = list(range(n + 1)), list(range(n + 1))  # of which 0 and n stand for no time

        def seek(way: list[int], i: int) -> int:
            end = i
            while way[end] != end:
                end = way[end]
            while way[i] != end:
                way[i], i = end, way[i]
            return end

        def used_up(i: int) -> None:
            before[i + 1], after[i] = i, i + 1

        for i in range(n):
            if gone[i] >= size[i]:
                used_up(i)
        out = []
        for car, t in zip(cars["car_id"].tolist(), cars["t"].tolist()):
            at, best = bisect_left(times, t), None
            i = seek(before, at)
            while i and times[i - 1] >= t - most:
                own = (abs(times[i - 1] - t), ids[start[i - 1] + gone[i - 1]], i - 1)
                if best and own[0] > best[0]:
                    break
                best = min(best, own) if best else own
                i = seek(before, i - 1)
            i = seek(after, at)
            while i < n and times[i] <= t + most:
                own = (abs(times[i] - t), ids[start[i] + gone[i]], i)
                if best and own[0] > best[0]:
                    break
                best = min(best, own) if best else own
                i = seek(after, i + 1)
            if best:
                at = best[2]
                out.append((car, best[1]))
                gone[at] += 1
                if gone[at] == size[at]:
                    used_up(at)
        end = cars["t"].iloc[-1] - most if len(cars) else np.inf
        stays = [i for i in range(bisect_left(times, end), n) if gone[i]]
        found = pd.DataFrame(out, columns=["car_id", "track_id"], dtype=object).assign(recording=rows["recording"].iloc[0])
        return found, [np.array([times[i] for i in stays], dtype=float), np.array([gone[i] for i in stays], dtype="int64")]

    return fold


def nearest_time_match(cars: DataFrame, tracks: DataFrame, most: float, each: int = 65_536) -> DataFrame:
    """recording, car_id, track_id: cars in order of crossing (t, then car_id) each claim the nearest track nobody
    claimed, within `most`; the smaller id if tied. Gone through in parts of `each` cars (see fold_in_parts) with the
    tracks near them, never as all pairs that are near enough, which grow with the square of what passes at a time."""
    timed = lambda df, key: df.select("recording", key, F.col("t").cast("double").alias("t")).na.drop()
    cars, tracks = timed(cars, "car_id"), timed(tracks, "track_id")
    cars = written(numbered(cars, ["recording", "t", "car_id"], "at").withColumn("part", F.floor(F.col("at") / each)).drop("at"))
    stretch = _stretch("t", most)
    spans = cars.select("recording", "part", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")).distinct()
    near = tracks.withColumn("stretch", stretch).join(spans, ["recording", "stretch"]).select("recording", "part", "t", "track_id")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((cars, "recording"), (cars, "car_id"), (tracks, "track_id")))
    return fold_in_parts(cars.unionByName(near, allowMissingColumns=True), "recording", _claims(most), kinds)


def match_reference_box(directions: DataFrame, reference: DataFrame) -> DataFrame:
    """The detection of each image that overlaps the known box most, if there is any."""
    a, b = directions.alias("a"), reference.alias("b")
    p, q = (Box(*(F.col(f"{s}.{c}") for c in "xywh")) for s in "ab")
    scored = a.join(b, F.col("a.image_id") == F.col("b.image_id")).select(F.col("a.image_id").alias("image_id"), F.col("a.idx").alias("idx"), F.col("a.label").alias("label"), box_iou(p, q).alias("iou"))
    w = Window.partitionBy("image_id").orderBy(F.col("iou").desc(), "idx")
    return scored.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
