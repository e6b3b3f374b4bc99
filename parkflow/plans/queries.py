"""Registered queries of the detection analytics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkflow.functions import clock, geometry, labels, vectors
from parkflow.functions.geometry import Box
from parkflow.operators import catalog, filters, graph, histograms, occupancy, plates, scoring, similarity, speed, tracking
from parkflow.plans import reports
from parkflow.plans.fixtures import view, with_views
from parkflow.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The SQL over the derived views as it is written here, for queries that go on from another's rows.
RAW: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function's name as a query, and its SQL over the derived views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            RAW[f.__name__] = sql
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


BOXES = """boxes as (select event_id, (event_id*37)%1800 as ax, (event_id*53)%1000 as ay, 20+(event_id*7)%120 as aw, 20+(event_id*13)%160 as ah,
    (event_id*41)%1800 as bx, (event_id*59)%1000 as "by", 20+(event_id*11)%120 as bw, 20+(event_id*17)%160 as bh from events)"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Box, Box]:
    e = F.col("event_id")
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((e * 37) % 1800).alias("ax"), ((e * 53) % 1000).alias("ay"), (20 + (e * 7) % 120).alias("aw"), (20 + (e * 13) % 160).alias("ah"), ((e * 41) % 1800).alias("bx"), ((e * 59) % 1000).alias("by"), (20 + (e * 11) % 120).alias("bw"), (20 + (e * 17) % 160).alias("bh"))
    return df, *(Box(*(F.col(s + c) for c in "xywh")) for s in "ab")


IOU = """case when least(ax+aw,bx+bw)>greatest(ax,bx) and least(ay+ah,"by"+bh)>greatest(ay,"by")
    then (least(ax+aw,bx+bw)-greatest(ax,bx))*(least(ay+ah,"by"+bh)-greatest(ay,"by")) else 0 end"""


@query(f"""with {BOXES}, pairs as (select *, {IOU} as common from boxes)
select event_id, aw*ah as area, ax+aw/2.0 as cx, ay+ah/2.0 as cy, cast(ax+aw//2 as bigint) as icx, cast(ay+ah//2 as bigint) as icy,
  round(cast(common as double)/(aw*ah+bw*bh-common),9) as iou, (ax<bx+bw and bx<ax+aw and ay<"by"+bh and "by"<ay+ah) as hit,
  round(aw/cast(ah as double),9) as aspect,
  (ax<=bx+bw+60 and bx<=ax+aw+60 and ay<="by"+bh+60 and "by"<=ay+ah+60) as close,
  (ax<=bx+bw+60 and bx<=ax+aw+60 and ay<="by"+"by"+60 and "by"<=ay+ay+60) as close_compat,
  (greatest(aw*ah,bw*bh) <= 2.5*least(aw*ah,bw*bh)) as alike,
  cast(least(ax,bx) as bigint) as ux, cast(greatest(ay+ah,"by"+bh)-least(ay,"by") as bigint) as uh,
  cast(least(1920, ax+aw+cast(floor(aw*0.1) as bigint)) - greatest(0,ax-cast(floor(aw*0.1) as bigint)) as bigint) as padded_w,
  cast(aw-2*cast(floor(aw*0.2) as bigint) as bigint) as inner_w, cast(floor(aw*10/100.0) as bigint) as margin_x,
  case when bx+bw/2.0>=ax+aw/2.0 then 'right' else 'left' end as motion,
  case when bx+bw//2>ax+aw//2 then 'right' else 'left' end as motion_strict,
  round(sqrt((bx+bw/2.0-ax-aw/2.0)*(bx+bw/2.0-ax-aw/2.0)+("by"+bh/2.0-ay-ah/2.0)*("by"+bh/2.0-ay-ah/2.0))/2.5,9) as speed,
  aw*ah*0.5 as quality from pairs""")
def b_geometry(spark, sf_dir):
    """B4-B7, B10-B13, B38-B42, B45."""
    df, a, b = _boxes(spark, sf_dir)
    (cx, cy), (icx, icy), u = geometry.box_center(a), geometry.box_center_int(a), geometry.union_box(a, b)
    ints = lambda c: c.cast("long")
    return df.select(
        "event_id", geometry.box_area(a).alias("area"), cx.alias("cx"), cy.alias("cy"), ints(icx).alias("icx"), ints(icy).alias("icy"), F.round(geometry.box_iou(a, b), 9).alias("iou"), geometry.box_intersects(a, b).alias("hit"), F.round(geometry.aspect_ratio(a), 9).alias("aspect"),
        geometry.boxes_close(a, b, 60).alias("close"), geometry.boxes_close(a, b, 60, compat=True).alias("close_compat"), geometry.similar_size(a, b, 2.5).alias("alike"), ints(u.x).alias("ux"), ints(u.h).alias("uh"),
        ints(geometry.pad_box(a, 0.1, F.lit(1920), F.lit(1080)).w).alias("padded_w"), ints(geometry.center_box(a.w, a.h, 0.2).w).alias("inner_w"), ints(geometry.margin_region(a.w, a.h, F.lit(10)).x).alias("margin_x"),
        geometry.motion_direction(a, b).alias("motion"), F.when(geometry.box_center_int(b)[0] > geometry.box_center_int(a)[0], "right").otherwise("left").alias("motion_strict"), F.round(geometry.pixel_speed(a, b, F.lit(2.5)), 9).alias("speed"), geometry.quality_score(a, F.lit(0.5)).alias("quality"),
    )


@query(f"""with {BOXES}, z as (select *, (ax<700 and 100<ax+aw and ay<400 and 0<ay+ah) as shut, (ax<1700 and 300<ax+aw and ay<900 and 200<ay+ah) as fenced from boxes)
select event_id, (shut or not fenced) as out, cast(aw as int)-cast(ax%20 as int) as corner_w, cast(floor(0.25*aw) as int) as zone_x, cast(floor(0.5*ah) as int) as zone_h from z""")
def b_zones(spark, sf_dir):
    """B3, B8, B9."""
    df, a, _ = _boxes(spark, sf_dir)
    box = lambda kind, *v: F.struct(F.lit(kind).alias("type"), *[F.lit(x).alias(c) for x, c in zip(v, "xywh")])
    zones = F.array(box("exclude", 100, 0, 600, 400), box("include", 300, 200, 1400, 700))
    shape = F.struct(F.lit(None).cast("array<double>").alias("rect"), F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.25, 0.125), (0.75, 0.625))]).alias("points"))
    zone, corners = geometry.zone_to_pixels(shape, a.w, a.h), geometry.box_from_corners(a.x % 20, a.y, a.w, a.h)
    return df.select("event_id", geometry.excluded_by_zones(a, zones).alias("out"), corners.w.alias("corner_w"), zone.x.alias("zone_x"), zone.h.alias("zone_h"))


@query("""select type_id, direction_lr, direction_fb, case type_id when 5 then 2 when 7 then 2 when 3 then 1 else type_id end as merged,
  case type_id when 0 then 'person' when 1 then 'bicycle' when 2 then 'car' when 3 then 'motorcycle' when 5 then 'bus' end as name,
  case direction_lr when -1 then 'left' when 1 then 'right' else 'unknown' end as side,
  case direction_fb when 1 then 'forward' when -1 then 'back' else 'unknown' end as way, count(*) as n from instance group by all""")
def b_labels(spark, sf_dir):
    """B1, B2, B25."""
    side, way = labels.direction_words(F.col("direction_lr"), F.col("direction_fb"))
    t = F.col("type_id")
    return view(spark, sf_dir, "instance").groupBy("type_id", "direction_lr", "direction_fb", labels.merge_class(t).alias("merged"), labels.class_label(t).alias("name"), side.alias("side"), way.alias("way")).agg(F.count("*").alias("n"))


@query("""select name, case when event_id%6 in (0) then 'left' when event_id%6=1 then 'right' when event_id%6=2 then 'front' when event_id%6=5 then 'back' end as label,
  regexp_replace(name,'\\.[^.]*$','') as stem, '.JPG' as suffix, case when name like '%left%' then 'RIGHT_LEFT' when name like '%right%' then 'LEFT_RIGHT' else 'UNKNOWN' end as way from labeled_image""")
def b_file_names(spark, sf_dir):
    """B16, B27, B44."""
    n = F.col("name")
    return view(spark, sf_dir, "labeled_image").select("name", labels.label_from_filename(n, ["left", "right", "front", "back"]).alias("label"), labels.stem(n).alias("stem"), labels.suffix(n).alias("suffix"), labels.direction_from_name(n).alias("way"))


@query("""select truth, plate_text, regexp_replace(upper(' '||substr(lower(plate_text),1,3)||'-'||substr(plate_text,4)),'[^A-Z0-9]','','g') as normal,
  cast(levenshtein(truth,coalesce(plate_text,'')) as int) as edits, (levenshtein(truth,coalesce(plate_text,''))<=1) as near, split_part(img_path,'/',1) as folder, count(*) as n from plate_reading group by all""")
def b_plates(spark, sf_dir):
    """B14, B15, B28."""
    p = F.col("plate_text")
    messy = F.concat(F.lit(" "), F.substring(F.lower(p), 1, 3), F.lit("-"), F.substring(p, 4, 99))
    read = F.coalesce(p, F.lit(""))
    return view(spark, sf_dir, "plate_reading").groupBy("truth", "plate_text", vectors.normalize_plate(messy).alias("normal"), vectors.edit_distance(F.col("truth"), read).alias("edits"), vectors.within_edits(F.col("truth"), read, 1).alias("near"), labels.video_group(F.col("img_path"), F.lit(None).cast("string")).alias("folder")).agg(F.count("*").alias("n"))


@query("""select c.event_id, case event_id%4 when 3 then null when 2 then 'time_of_day' else 'epoch' end as kind,
  case event_id%4 when 3 then null when 2 then cast((epoch_us(ts)//1000000)%86400 as double) else cast(epoch_us(ts)//1000000 as double) end as seconds,
  (epoch_us(ts)//1000000)%86400 as tod, (epoch_us(ts)//1000000) - (epoch_us(ts)//1000000)%60 - 60*(((epoch_us(ts)//1000000)//60)%60%25) as floor25,
  strftime(ts,'%H:%M:%S') as hms, strftime(ts,'%Y-%m-%d/%H-%M-%S.jpg') as path, cast(epoch_us(ts)//1000000 as double) as from_path,
  cast(epoch_us(ts)//1000000 as double) + event_id%300/25.0 as frame_s, case event_id%4 when 3 then 'path' else 'text' end as source
  from clock_text c join events using (event_id)""")
def b_clock(spark, sf_dir):
    """B17-B24."""
    ts = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    df = view(spark, sf_dir, "clock_text").join(ts, "event_id")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    df = df.withColumn("epoch", epoch).withColumn("path", F.date_format("ts", "yyyy-MM-dd/HH-mm-ss'.jpg'"))
    text, path = clock.parse_clock_text(F.col("txt"), 2026), clock.timestamp_from_path(F.col("path"))
    e = F.col("epoch")
    return df.select("event_id", text["kind"].alias("kind"), text["seconds"].alias("seconds"), clock.time_of_day(e).alias("tod"), clock.interval_floor(e, 25).alias("floor25"), clock.format_hms(e).alias("hms"), "path", path["seconds"].alias("from_path"), clock.frame_time(e.cast("double"), F.col("event_id") % 300, F.lit(25.0)).alias("frame_s"), clock.resolve_timestamp(("text", text), ("path", path))["source"].alias("source"))


@query("""with k as (select event_id, i, kx, ky, conf from keypoint where conf>=0.3),
 s as (select event_id,
  sum(case when i in (1,2,3,9,10) and kx>0 and ky>0 then kx end)/cast(count(case when i in (1,2,3,9,10) and kx>0 and ky>0 then 1 end) as double) as f, count(case when i in (1,2,3,9,10) and kx>0 and ky>0 then 1 end) as nf,
  sum(case when i in (5,6,11,12) and kx>0 and ky>0 then kx end)/cast(count(case when i in (5,6,11,12) and kx>0 and ky>0 then 1 end) as double) as b, count(case when i in (5,6,11,12) and kx>0 and ky>0 then 1 end) as nb,
  sum(case when i%2=1 and i<16 and kx>0 and ky>0 then kx end)/cast(count(case when i%2=1 and i<16 and kx>0 and ky>0 then 1 end) as double) as l, count(case when i%2=1 and i<16 and kx>0 and ky>0 then 1 end) as nl,
  sum(case when i%2=0 and i>0 and kx>0 and ky>0 then kx end)/cast(count(case when i%2=0 and i>0 and kx>0 and ky>0 then 1 end) as double) as r, count(case when i%2=0 and i>0 and kx>0 and ky>0 then 1 end) as nr from k group by event_id),
 v as (select event_id, avg(case when i in (0,1,4,5,9,10) then kx end) as vf, count(case when i in (0,1,4,5,9,10) then 1 end) as nvf, avg(case when i in (2,3,6,7,11,12) then kx end) as vr, count(case when i in (2,3,6,7,11,12) then 1 end) as nvr from keypoint where conf>=0.5 group by event_id),
 d as (select e.event_id, case when nf is null or nf<2 or nb<2 or f=b then 0 when f<b then -1 else 1 end as lr, case when nl is null or nl<2 or nr<2 or l=r then 0 when l<r then -1 else 1 end as fb,
  case when nvf is null or nvf<2 or nvr<2 or vf=vr then 'unknown' when vf>vr then 'right' else 'left' end as car, (coalesce(nvf,0)+coalesce(nvr,0))/12.0 as car_confidence from events e left join s using(event_id) left join v using (event_id))
 select event_id, lr, fb, case when lr=1 then 'right' when lr=-1 then 'left' when fb=1 then 'front' when fb=-1 then 'back' else 'unknown' end as label, car, round(car_confidence,9) as car_confidence from d""")
def b_poses(spark, sf_dir):
    """B36, B37."""
    points = view(spark, sf_dir, "keypoint").groupBy("event_id").agg(F.collect_list(F.struct("i", F.col("kx").alias("x"), F.col("ky").alias("y"), "conf")).alias("p"))
    pose, car = vectors.pose_direction(F.col("p"), 0.3), vectors.vehicle_pose_direction(F.col("p"))
    return points.select("event_id", pose["left_right"].alias("lr"), pose["front_back"].alias("fb"), pose["label"].alias("label"), car["label"].alias("car"), F.round(car["confidence"], 9).alias("car_confidence"))


@query("""with p as (select vec_id, vec_id//2 as pair, ar10, embedding from profile), j as (select a.pair, a.embedding as u, b.embedding as v, abs(a.ar10-b.ar10)/10.0 as gap from p a join p b on a.pair=b.pair and a.vec_id<b.vec_id),
 s as (select pair, gap, list_dot_product(cast(u as double[]),cast(v as double[])) as c, list_sum(list_transform(list_zip(u,v), lambda x: sqrt(abs(cast(x[1] as double))*abs(cast(x[2] as double))))) as root,
  sqrt(list_sum(list_transform(u, lambda x: abs(cast(x as double))))*list_sum(list_transform(v, lambda x: abs(cast(x as double))))) as total from j),
 t as (select pair, gap, c, 1-sqrt(greatest(0.0,1-root/total)) as color from s)
 select pair, round(c,6) as cosine, round(color,6) as color, round((0.7*c+0.3*color)*(0.8+0.2*exp(-4*gap)),6) as fused from t""")
def b_vectors(spark, sf_dir):
    """B29-B31."""
    p = view(spark, sf_dir, "profile").withColumn("pair", F.floor(F.col("vec_id") / 2))
    a = p.filter("vec_id % 2 = 0").select("pair", F.col("embedding").alias("u"), F.col("ar10").alias("ra"))
    j = a.join(p.filter("vec_id % 2 = 1").select("pair", F.col("embedding").alias("v"), F.col("ar10").alias("rb")), "pair")
    positive = lambda v: F.transform(v, F.abs)
    j = j.withColumns({"c": vectors.cosine(F.col("u"), F.col("v")), "h": vectors.color_similarity(positive("u"), positive("v"))})
    gap = F.abs(F.col("ra") - F.col("rb")) / 10
    return j.select("pair", F.round("c", 6).alias("cosine"), F.round("h", 6).alias("color"), F.round(vectors.fused_similarity(F.col("c"), F.col("h"), gap, F.lit(False), F.lit(False), F.lit(False)), 6).alias("fused"))


@query("""with s as (select raw_c, entity_id, (raw_c-min(raw_c) over ())/cast(max(raw_c) over ()-min(raw_c) over () as double)*40+10 as scaled from entity)
select entity_id, round(scaled,9) as scaled, case when scaled between 10 and 50 then case when abs(scaled-10)<=abs(scaled-25) then 10.0 when abs(scaled-25)<=abs(scaled-50) then 25.0 else 50.0 end end as bin,
  case when entity_id%9=0 then null when entity_id%9>=4 then '4+' else cast(entity_id%9 as varchar) end as miss,
  case when entity_id%100/100.0<=0.05 then '<=5%' when entity_id%100/100.0<=0.2 then '<=20%' when entity_id%100/100.0<=0.5 then '<=50%' else '>50%' end as err from s""")
def b_bins(spark, sf_dir):
    """B32-B35."""
    df = histograms.scaled(view(spark, sf_dir, "entity"), "raw_c", 10.0, 50.0, "scaled")
    return df.select("entity_id", F.round("scaled", 9).alias("scaled"), vectors.nearest_bin(F.col("scaled"), [10.0, 25.0, 50.0]).alias("bin"), labels.miss_bucket(F.col("entity_id") % 9).alias("miss"), labels.relative_error_bucket(F.col("entity_id") % 100 / 100).alias("err"))


@query("""select concat(regexp_replace(video,'\\.[^.]*$',''),'/entity_',entity_id,'_',direction,'_',coalesce(case entity_type when 0 then 'person' when 1 then 'bicycle' when 2 then 'car' end,'vehicle')) as name,
 case entity_type when 0 then 'person' when 1 then 'bicycle' when 2 then 'car' when 99 then 'unknown (99)' else 'unknown' end as label,
 case when direction='left' then 'RIGHT_LEFT' else 'LEFT_RIGHT' end as opt, case when entity_id%2=0 then [2,0] else [1,7,-1] end as classes from video_entity""")
def b_names(spark, sf_dir):
    """B2 (report form), B26, B43, B46."""
    df = view(spark, sf_dir, "video_entity")
    tokens = F.when(F.col("entity_id") % 2 == 0, F.array(F.lit("Car"), F.lit("2"), F.lit("nothing"), F.lit("person"))).otherwise(F.array(F.lit("bicycle"), F.lit("7"), F.lit("plate"), F.lit("truck")))
    t = F.col("entity_type")
    return df.select(labels.best_frame_name(F.col("video"), F.col("entity_id"), F.col("direction"), labels.class_label(t), "vehicle").alias("name"), labels.class_label(t, report=True).alias("label"), labels.parse_direction_option(F.concat(F.lit(" "), F.upper("direction"))).alias("opt"), labels.resolve_classes(tokens).alias("classes"))


# Filters and sets over images, instances and entities


def _catalog(spark, sf_dir):
    return tuple(view(spark, sf_dir, n) for n in ("image", "instance", "entity"))


@query("""select * from detection where class_id in (2) and w>0 and h>0 and x<1200 and 600<x+w and y<700 and 100<y+h and frame_index%3=0""")
def c_detections(spark, sf_dir):
    """C1-C3, C21."""
    df = filters.drop_degenerate_boxes(filters.keep_classes(view(spark, sf_dir, "detection"), (2,)))
    return filters.downsample_frames(filters.keep_region(df, Box(*map(F.lit, (600, 100, 600, 600)))), 3)


@query("""select 'analyzed' as f, image_id as id from image where analyzed union all select 'time', image_id from image where epoch_s%86400 between 28800 and 64800
 union all select 'dates', image_id from image where epoch_s between 1704412800 and 1704931199
 union all select 'with_any', image_id from (select image_id from instance where confidence>=0.5 group by 1)
 union all select 'with_type', image_id from (select image_id, count(*) n from instance where confidence>=0.2 and type_id=1 group by 1) where n between 2 and 4
 union all select 'without', i.image_id from image i left join (select image_id, max(confidence) c from instance where type_id=0 group by 1) q using (image_id) where coalesce(c,0)<=0.6
 union all select 'clusters', image_id from (select image_id, count(distinct cluster) n from instance join entity using (entity_id) group by 1) where n between 3 and 6""")
def c_images(spark, sf_dir):
    """C5-C10."""
    image, instance, entity = _catalog(spark, sf_dir)
    found = {"analyzed": filters.images_analyzed(image), "time": filters.images_in_time(image, 28800, 64800), "dates": filters.images_in_dates(image, 1704412800, 1704844800), "with_any": filters.images_with_entities(image, instance, None, 0.5), "with_type": filters.images_with_entities(image, instance, 1, 0.2, 2, 4), "without": filters.images_without(image, instance, 0, 0.6), "clusters": filters.images_by_cluster_count(instance, entity, 3, 6)}
    return _tagged(found, "image_id")


def _tagged(found: dict[str, DataFrame], key: str) -> DataFrame:
    return plates.pool_directories(*[df.select(F.lit(k).alias("f"), F.col(key).alias("id")) for k, df in found.items()])


@query("""with seen as (select * from instance join image using (image_id))
 select distinct 'dates' as f, entity_id as id from seen where epoch_s between 1704412800 and 1704585599
 union all select distinct 'dates_compat', entity_id from seen where epoch_s between 1704412800 and 1704499200
 union all select distinct 'time', entity_id from seen where epoch_s%86400 between 3600 and 5400
 union all select distinct 'type', entity_id from instance where type_id=3
 union all select 'cluster_size', entity_id from entity where cluster in (select cluster from entity group by 1 having count(*) between 2 and 3)
 union all select 'sightings', entity_id from instance where confidence>=0.4 group by entity_id having count(*) between 10 and 60
 union all select distinct 'left', entity_id from instance where direction_lr=-1
 union all select distinct 'unknown', entity_id from instance where direction_lr=0 or direction_fb=0
 union all select 'speed', entity_id from entity where raw_c between 100000 and 300000""")
def c_entities(spark, sf_dir):
    """C11-C17."""
    image, instance, entity = _catalog(spark, sf_dir)
    found = {
        "dates": filters.entities_in_dates(instance, image, 1704412800, 1704499200), "dates_compat": filters.entities_in_dates(instance, image, 1704412800, 1704499200, compat=True), "time": filters.entities_in_time(instance, image, 3600, 5400), "type": filters.entities_of_type(instance, 3),
        "cluster_size": filters.entities_by_cluster_size(entity, 2, 3), "sightings": filters.entities_by_sightings(instance, 0.4, 10, 60), "left": filters.entities_by_direction(instance, "left"), "unknown": filters.entities_by_direction(instance, "unknown"), "speed": filters.entities_by_speed(entity, 100000, 300000, "raw_c"),
    }
    return _tagged(found, "entity_id")


@query("""select distinct 'left' as f, entity_id as id from instance where direction_lr=-1
 union all select distinct 'unknown', entity_id from instance where direction_lr=0 or direction_fb=0""")
def c_entities_direction(spark, sf_dir):
    """C16 over all entities."""
    _, instance, _ = _catalog(spark, sf_dir)
    return _tagged({k: filters.entities_by_direction(instance, k) for k in ("left", "unknown")}, "entity_id")


@query("""with a as (select image_id from image where analyzed), b as (select image_id from instance where confidence>=0.5 and type_id=2), c as (select image_id from image where epoch_s%86400<=21600), d as (select image_id from instance where type_id=5)
 select distinct image_id from (select image_id from a intersect select image_id from b union select image_id from c intersect select image_id from d)""")
def c_expression(spark, sf_dir):
    """C22, H1, H2."""
    image, instance, _ = _catalog(spark, sf_dir)
    return filters.filter_expression([[filters.images_analyzed(image), filters.images_with_entities(image, instance, 2, 0.5)], [filters.images_in_time(image, 0, 21600), filters.images_with_entities(image, instance, 5, 0.0)]])


@query("""select name from labeled_image where (event_id%6=4 or event_id%6=0) and regexp_replace(name,'\\.[^.]*$','') like '%8'""")
def c_profiling(spark, sf_dir):
    """C19."""
    df = view(spark, sf_dir, "labeled_image").withColumnRenamed("name", "path")
    return filters.images_for_profiling(df, ["8"], "RIGHT_LEFT").select(F.col("path").alias("name"))


# Joins and catalogue


@query("""select e.entity_id, count(*) as sightings, count(distinct i.image_id) as images, max(epoch_s)-min(epoch_s) as span_s, min(i.image_id) as earliest, max(i.image_id) as latest from entity e join instance i using (entity_id) join image m using (image_id) group by 1""")
def d_sightings(spark, sf_dir):
    """D1, E11, G2."""
    image, instance, entity = _catalog(spark, sf_dir)
    seen = catalog.entity_sightings(entity, instance, image)
    n = seen.groupBy("entity_id").agg(F.count("*").alias("sightings"), F.count_distinct("image_id").alias("images"))
    return n.join(catalog.entity_span(seen), "entity_id").join(catalog.entity_earliest_latest(seen), "entity_id")


@query("""select m.image_id, count(i.entity_id) as n from image m left join instance i on m.image_id=i.image_id and i.type_id=1 group by 1""")
def d_left_instances(spark, sf_dir):
    """D3."""
    image, instance, _ = _catalog(spark, sf_dir)
    return catalog.image_left_instances(image, instance, 1).groupBy("image_id").agg(F.count("entity_id").alias("n"))


@query("""select 'strict' as f, a.entity_id, b.entity_id as mate_id from entity a join entity b on a.cluster=b.cluster and a.entity_id<>b.entity_id
 union all select 'compat', a.entity_id, b.entity_id from entity a join entity b on a.cluster is not distinct from b.cluster and a.entity_id<>b.entity_id""")
def d_cluster_mates(spark, sf_dir):
    """D4."""
    entity = view(spark, sf_dir, "entity")
    return catalog.cluster_mates(entity).select(F.lit("strict").alias("f"), "*").unionByName(catalog.cluster_mates(entity, compat=True).select(F.lit("compat").alias("f"), "*"))


@query("""select distinct img_path as path, true as new from plate_reading where img_path like 'cam1%' union all select distinct img_path, false from plate_reading where img_path like 'cam0%'""")
def d_import(spark, sf_dir):
    """A11, D5."""
    paths = view(spark, sf_dir, "plate_reading").select(F.col("img_path").alias("path"))
    known = paths.filter("path like 'cam0%'").distinct()
    new = catalog.unseen_paths(paths, known).distinct().select("path", F.lit(True).alias("new"))
    return catalog.import_new(known, paths).join(new, "path", "left").select("path", F.coalesce("new", F.lit(False)).alias("new"))


@query("""select distinct i.image_id from instance i where entity_id in (select entity_id from entity where raw_c>300000)""")
def d_images_of_entities(spark, sf_dir):
    """D6."""
    _, instance, entity = _catalog(spark, sf_dir)
    return catalog.images_of_entities(instance, filters.entities_by_speed(entity, 300001, 1e15, "raw_c"))


@query("""with k as (select cluster, count(*)-1 as mates from entity group by 1) select entity_id, e.cluster, case when e.cluster is null then 0 else mates end as mates, mates as compat_mates from entity e join k on e.cluster is not distinct from k.cluster""")
def d_cluster_members(spark, sf_dir):
    """D4 as membership, which doesn't grow with the square of a cluster."""
    entity = view(spark, sf_dir, "entity")
    return catalog.cluster_members(entity).join(catalog.cluster_members(entity, compat=True).select("entity_id", F.col("mates").alias("compat_mates")), "entity_id")


TYPES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus"}


@query("""with b as (select image_id, epoch_s, epoch_s - epoch_s%60 - 60*((epoch_s//60)%60%45) as bucket from image),
 s as (select b.bucket, i.*, row_number() over (partition by b.bucket, i.entity_id order by b.epoch_s, i.image_id) as rn from instance i join b using (image_id)),
 f as (select s.*, e.cluster from s left join entity e using (entity_id) where rn=1),
 c as (select bucket, count(*) filter (type_id=0) as a, count(*) filter (type_id=1) as b2, count(*) filter (type_id=2) as c2, count(*) filter (type_id=3) as d, count(*) filter (type_id=5) as e,
   count(distinct cluster)+count(distinct case when cluster is null then image_id end) as k from f group by 1)
 select x.bucket, coalesce(a,0) as "person count", coalesce(b2,0) as "bicycle count", coalesce(c2,0) as "car count", coalesce(d,0) as "motorcycle count", coalesce(e,0) as "bus count", coalesce(k,0) as "cluster count" from (select distinct bucket from b) x left join c using (bucket)""")
def e_interval_counts(spark, sf_dir):
    """E7, E8, F4."""
    return catalog.counts_per_interval(*_catalog(spark, sf_dir), 45, TYPES)


@query("""with b as (select image_id, epoch_s as bucket from image), s as (select b.bucket, i.*, row_number() over (partition by b.bucket, i.entity_id order by i.image_id) as rn from instance i join b using (image_id))
 select x.bucket, count(*) filter (type_id=0 and direction_lr=-1) as "person count - left", count(*) filter (type_id=0 and direction_lr=1) as "person count - right", count(*) filter (type_id=0 and direction_fb=1) as "person count - forward", count(*) filter (type_id=0 and direction_fb=-1) as "person count - back",
  count(distinct cluster)+count(distinct case when s.entity_id is not null and cluster is null then image_id end) as "cluster count" from (select distinct bucket from b) x left join s on s.bucket=x.bucket and rn=1 left join entity e on e.entity_id=s.entity_id group by 1""")
def e_direction_counts(spark, sf_dir):
    """E7 with directions."""
    return catalog.counts_per_image(*_catalog(spark, sf_dir), {0: "person"}, directions=True)


@query("""with s as (select entity_id, min(epoch_s) as a, max(epoch_s) as b, min(image_id) as m from instance join image using (image_id) group by 1), k as (select cluster, count(*) n from entity where cluster is not null group by 1)
 select e.entity_id, a as first_s, b as last_s, b-a as dwell_s, lpad(cast(((b-a)%86400)//3600 as varchar),2,'0')||':'||lpad(cast(((b-a)%3600)//60 as varchar),2,'0')||':'||lpad(cast((b-a)%60 as varchar),2,'0') as dwell,
  case i.type_id when 0 then 'person' when 1 then 'bicycle' when 2 then 'car' when 3 then 'motorcycle' when 5 then 'bus' end as type, coalesce(k.n,0) as cluster_size,
  case i.direction_lr when -1 then 'left' when 1 then 'right' else 'unknown' end as left_right, case i.direction_fb when 1 then 'forward' when -1 then 'back' else 'unknown' end as forward_back, round(raw_c/100.0,4) as speed
 from entity e join s using (entity_id) join instance i on i.entity_id=e.entity_id and i.image_id=s.m left join k using (cluster)""")
def e_entity_rollup(spark, sf_dir):
    """B24, E9."""
    image, instance, entity = _catalog(spark, sf_dir)
    return catalog.entity_rollup(entity.withColumn("speed", F.col("raw_c") / 100), instance, image)


@query("""with s as (select entity_id, min(epoch_s) as a, max(epoch_s) as b from instance join image using (image_id) group by 1), r as (select false as compat, cluster, min(a) as first_s, max(b) as end_s, count(*) as size from entity join s using (entity_id) where cluster is not null group by all union all select true, cluster, min(a), min(b), count(*) from entity join s using (entity_id) group by all)
 select compat, cluster, first_s, end_s, size, end_s-first_s as dwell_s from r""")
def e_cluster_rollup(spark, sf_dir):
    """E10."""
    image, instance, entity = _catalog(spark, sf_dir)
    each = [catalog.cluster_rollup(entity, instance, image, c).select(F.lit(c).alias("compat"), "cluster", "first_s", "end_s", "size", "dwell_s") for c in (False, True)]
    return each[0].unionByName(each[1])


@query("""select distinct type_id from instance""")
def e_present_types(spark, sf_dir):
    """E6."""
    return catalog.present_types(view(spark, sf_dir, "instance"))


@query("""(select 'first' as f, image_id from image order by epoch_s, image_id limit 1) union all (select 'last', image_id from image order by epoch_s desc, image_id limit 1) union all (select 'page', image_id from image order by image_id limit 300 offset 300)""")
def g_gallery(spark, sf_dir):
    """G1, G3, G7."""
    image = view(spark, sf_dir, "image")
    return _tagged({"first": catalog.earliest_image(image), "last": catalog.latest_image(image), "page": catalog.page(catalog.sorted_gallery(image.select("image_id"), "image_id"), ["image_id"], 300)}, "image_id").withColumnRenamed("id", "image_id")


@query("""with m as (select entity_id, case when entity_id%10=3 then entity_id-1 else entity_id end as new from entity), moved as (select image_id, new as entity_id, type_id from instance join m using (entity_id)), kept as (select * from moved where image_id%5<>0)
 select e.entity_id, cluster, (select count(*) from kept k where k.entity_id=e.entity_id) as n from entity e where e.entity_id in (select entity_id from kept)""")
def k_maintenance(spark, sf_dir):
    """K11-K13."""
    image, instance, entity = _catalog(spark, sf_dir)
    mapping = entity.filter("entity_id % 10 = 3").select(F.col("entity_id").alias("old_id"), (F.col("entity_id") - 1).alias("new_id"))
    entity, instance = catalog.reassign_entities(entity, instance, mapping)
    kept = catalog.cascade_delete(instance, image.filter("image_id % 5 = 0").select("image_id"))
    n = kept.groupBy("entity_id").agg(F.count("*").alias("n"))
    return catalog.drop_orphan_entities(entity, kept).join(n, "entity_id").select("entity_id", "cluster", "n")


@query("""select image_id, count(*) as n, bool_or(fresh) as fresh from (select image_id, false as fresh from instance where image_id%4<>0 union all select image_id, true from image where image_id%4=0) group by 1""")
def k_replace(spark, sf_dir):
    """K9."""
    image, instance, entity = _catalog(spark, sf_dir)
    done = image.filter("image_id % 4 = 0").select("image_id")
    new = done.select("image_id", F.lit(2).alias("type_id"), F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("width"), F.lit(4).alias("height"), F.lit(0.9).alias("confidence"))
    _, kept, _ = catalog.replace_analysis(entity, instance, image, done, new)
    return kept.groupBy("image_id").agg(F.count("*").alias("n"), F.bool_or((F.col("confidence") == 0.9) & (F.col("width") == 3)).alias("fresh"))


@query("""select distinct concat(video,'-frames/',frame_index,'.jpg') as path, 1000+frame_index/25.0 as epoch_s from detection""")
def k_frames(spark, sf_dir):
    """B21, K10."""
    return catalog.frames_to_images(view(spark, sf_dir, "detection"), F.lit(1000.0), 25.0).select("path", "epoch_s")


# Plates


def _readings(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "plate_reading").withColumn("t", F.col("t_us") / 1e6)


@query("""with g as (select plate_text, min(t_us)/1e6 as entry, max(t_us)/1e6 as exit, arg_min(img_path,(t_us,img_path)) as entry_image, arg_max(img_path,(t_us,img_path)) as exit_image, count(*) as sightings from plate_reading where plate_text is not null group by 1 having count(*)>=2)
 select plate_text, entry, exit, entry_image, exit_image, exit-entry as dwell, sightings, exit-entry>=2000000 as counted from g""")
def e_plate_dwell(spark, sf_dir):
    """E15, E17."""
    return plates.plate_dwell(_readings(spark, sf_dir), 0, None, 2_000_000.0)


@query("""with g as (select max(t_us)/1e6-min(t_us)/1e6 as dwell, count(*) as n from plate_reading where plate_text is not null group by plate_text having count(*)>=2)
 select round(coalesce(avg(dwell) filter (dwell>=2000000),0),3) as average_dwell, count(*) filter (dwell<2000000) as excluded, round(avg(dwell) filter (dwell>=2000000),3) as mean_dwell, round(median(dwell) filter (dwell>=2000000),3) as median_dwell,
  (select count(*) from plate_reading) as images, (select count(plate_text) from plate_reading) as plates_read, count(*) as matched, (select count(plate_text) from plate_reading)-sum(n) as single_sightings from g""")
def e_dwell_averages(spark, sf_dir):
    """E17, E22, E47 (dwell_report_stats)."""
    readings = _readings(spark, sf_dir)
    matches = plates.plate_dwell(readings, 0, None, 2_000_000.0)
    a, b, c = plates.average_dwell(matches), plates.mean_median_dwell(matches), plates.dwell_report_stats(readings, matches)
    return a.crossJoin(b).crossJoin(c).select(F.round("average_dwell", 3).alias("average_dwell"), "excluded", F.round("mean_dwell", 3).alias("mean_dwell"), F.round("median_dwell", 3).alias("median_dwell"), "images", "plates_read", "matched", "single_sightings")


FUZZY = """t as (select distinct plate_text as p from plate_reading where plate_text is not null), e as (select a.p as a, b.p as b from t a join t b on levenshtein(a.p,b.p)<=1),
 reach as (select p as a, p as b from t union select reach.a, e.b from reach join e on reach.b=e.a), comp as (select a as plate_text, min(b) as plate_group from reach group by 1)"""


@query(f"""with recursive {FUZZY}, r as (select comp.plate_group, q.* from plate_reading q join comp using (plate_text)),
 v as (select plate_group, plate_text, count(*) as n, min(t_us) as f, min((t_us,img_path)) as k from r group by 1,2), w as (select *, row_number() over (partition by plate_group order by n desc, k) as rn from v)
 select (select w.plate_text from w where w.rn=1 and w.plate_group=r.plate_group) as plate_text, (select string_agg(w.plate_text, ',' order by w.plate_text) from w where w.plate_group=r.plate_group) as variants,
  min(t_us)/1e6 as entry, max(t_us)/1e6 as exit, count(*) as sightings from r group by r.plate_group having count(*)>=2""")
def e_plate_dwell_fuzzy(spark, sf_dir):
    """D12, E16, I1."""
    return plates.plate_dwell(_readings(spark, sf_dir), 1).select("plate_text", "variants", "entry", "exit", "sightings")


def _dwell_gap(gap: int) -> str:
    return f"""with recursive r as (select plate_text, t_us/1e6 as t, img_path, row_number() over (order by plate_text, t_us, img_path) as id from plate_reading where plate_text is not null),
 e as (select a.id as a, b.id as b from r a join r b on levenshtein(a.plate_text,b.plate_text)<=1 and abs(a.t-b.t)<={gap}),
 reach as (select id as a, id as b from r union select reach.a, least(reach.b, m.b) from reach join (select a, min(b) as b from e group by 1) m on reach.b=m.a),
 c as (select a, min(b) as g from reach group by 1),
 reach2 as (select a as a, g as b from c union select reach2.a, least(reach2.b, x.g) from reach2 join (select c1.g as h, min(c2.g) as g from e join c c1 on e.a=c1.a join c c2 on e.b=c2.a group by 1) x on reach2.b=x.h), c2 as (select a, min(b) as g from reach2 group by 1)
 select min(t) as entry, max(t) as exit, count(*) as sightings from r join c2 on r.id=c2.a group by c2.g having count(*)>=2"""


@query(_dwell_gap(100_000))
def e_plate_dwell_gap(spark, sf_dir):
    """D12 with a gap, E16, E17."""
    return plates.plate_dwell(_readings(spark, sf_dir), 1, 100_000.0).select("entry", "exit", "sightings")


@query(_dwell_gap(200_000))
def e_plate_dwell_gap_all(spark, sf_dir):
    """D12 with a gap, E16, E17 over all readings."""
    return plates.plate_dwell(_readings(spark, sf_dir), 1, 200_000.0).select("entry", "exit", "sightings")


CROSSINGS = FUZZY + """, grp as (select img_path, plate_group from plate_reading join comp using (plate_text)), sz as (select plate_group, count(*) as n, (select max(t_us)/1e6-min(t_us)/1e6 from plate_reading q join comp c on q.plate_text=c.plate_text where c.plate_group=grp.plate_group) as dwell from grp group by 1),
 x as (select truth, count(*) as sightings, count(plate_group) as rd, count(distinct plate_group) as clusters, min(plate_group) as plate_group, max(t_us)/1e6-min(t_us)/1e6 as true_dwell from plate_reading left join grp using (img_path) group by 1 having count(*)>=2),
 crossings as (select truth, sightings, clusters, case when clusters=0 then 'dropped' when clusters>1 then 'split' when rd=sightings and sz.n=sightings then 'exact' else 'corrupted' end as status, true_dwell, case when clusters=1 then sz.dwell end as ocr_dwell from x left join sz using (plate_group))"""


def _crossings(spark, sf_dir) -> DataFrame:
    readings = _readings(spark, sf_dir)
    groups = readings.join(plates.fuzzy_groups(readings, 1), "plate_text")
    ocr = groups.groupBy("plate_group").agg((F.max("t") - F.min("t")).alias("dwell"))
    return plates.classify_crossings(readings.select("img_path", "truth", "t"), groups, ocr)


@query(f"""with recursive {CROSSINGS} select truth, sightings, clusters, status, round(true_dwell,3) as true_dwell, round(ocr_dwell,3) as ocr_dwell from crossings""")
def e_crossings(spark, sf_dir):
    """D15, E18, G5."""
    return plates.ordered_crossings(_crossings(spark, sf_dir)).select("truth", "sightings", "clusters", "status", F.round("true_dwell", 3).alias("true_dwell"), F.round("ocr_dwell", 3).alias("ocr_dwell"))


@query(f"""with recursive {CROSSINGS} select count(*) filter (status='dropped') as n_dropped, count(*) filter (status='split') as n_split, count(*) filter (status='corrupted') as n_corrupted, count(*) filter (status='exact') as n_exact,
 round(avg(abs(ocr_dwell-true_dwell)) filter (status='corrupted' and ocr_dwell is not null and true_dwell>=2400000),3) as mean_abs_delta, count(*) filter (status='corrupted' and ocr_dwell is not null and true_dwell<2400000) as excluded from crossings""")
def e_crossing_summary(spark, sf_dir):
    """E20."""
    out = plates.crossing_status_summary(_crossings(spark, sf_dir), 2_400_000)
    return out.withColumn("mean_abs_delta", F.round("mean_abs_delta", 3))


@query(f"""with recursive {CROSSINGS}, o as (select abs(ocr_dwell-true_dwell)/true_dwell as e from crossings where ocr_dwell is not null and true_dwell>0 and true_dwell>=1000000)
 select case when e<=0.05 then '<=5%' when e<=0.2 then '<=20%' when e<=0.5 then '<=50%' else '>50%' end as bucket, count(*) as n, count(*)/cast((select count(*) from o) as double) as share, (select count(*) filter (e<=0.1)/cast(count(*) as double) from o) as within from o group by 1""")
def e_dwell_accuracy(spark, sf_dir):
    """E21."""
    return plates.dwell_accuracy(_crossings(spark, sf_dir), 1_000_000, 0.1)


@query("""with s as (select distinct plate_text as p, truth from plate_reading where plate_text is not null), t as (select truth from s group by 1 having count(*)>1) select distinct p as plate_text from s where truth in (select truth from t)""")
def e_split_fragments(spark, sf_dir):
    """E19 (every misread counts as a split here)."""
    readings = _readings(spark, sf_dir)
    split = readings.filter("plate_text is not null").groupBy("truth").agg(F.count_distinct("plate_text").alias("n")).filter("n > 1").select("truth", F.lit("split").alias("status"))
    return plates.split_fragments(readings.select("truth", "plate_text"), split)


OCR = """rows as (select case when right(img_path,6)='11.jpg' then '' when right(img_path,6)='12.jpg' then null else truth end as truth, plate_text, right(img_path,6)='13.jpg' as missing, split_part(img_path,'/',1) as video from plate_reading)"""
MEASURES = """count(*) as entries, count(*) filter (coalesce(truth,'')='' or missing) as thrown_out, count(*) filter (coalesce(truth,'')<>'' and not missing) as evaluated, count(distinct case when coalesce(truth,'')<>'' {seen} then truth end) as unique_plates,
 count(*) filter (coalesce(truth,'')<>'' and not missing and truth=plate_text) as exact_matches, count(*) filter (coalesce(truth,'')<>'' and not missing and truth=plate_text)/cast(count(*) filter (coalesce(truth,'')<>'' and not missing) as double) as match_rate,
 1-sum(levenshtein(truth,coalesce(plate_text,''))) filter (coalesce(truth,'')<>'' and not missing)/cast(sum(length(truth)) filter (coalesce(truth,'')<>'' and not missing) as double) as char_accuracy"""


def _scored(spark, sf_dir) -> DataFrame:
    tail = F.substring("img_path", -6, 6)
    return _readings(spark, sf_dir).select(F.when(tail == "11.jpg", "").when(tail == "12.jpg", None).otherwise(F.col("truth")).alias("truth"), "plate_text", (tail == "13.jpg").alias("missing"), labels.video_group(F.col("img_path"), F.lit(None).cast("string")).alias("video"))


@query(f"""with {OCR} select 'all' as video, {MEASURES.format(seen='')} from rows union all select video, {MEASURES.format(seen='and not missing')} from rows group by 1""")
def e_ocr_accuracy(spark, sf_dir):
    """E23, E24."""
    rows = _scored(spark, sf_dir)
    return plates.ocr_accuracy(rows).select(F.lit("all").alias("video"), "*").unionByName(plates.ocr_accuracy_by_video(rows))


@query("""with d as (select levenshtein(truth,coalesce(plate_text,'')) as d from plate_reading where truth is not null and levenshtein(truth,coalesce(plate_text,''))>0)
 select b.bucket, count(d) as n, count(d)/cast((select count(*) from d) as double) as share, (select avg(d) from d) as mean_distance, (select median(d) from d) as median_distance from (values ('1'),('2'),('3'),('4+')) b(bucket) left join d on (case when d>=4 then '4+' else cast(d as varchar) end)=b.bucket group by 1""")
def e_miss_distances(spark, sf_dir):
    """E25."""
    return plates.miss_distances(_readings(spark, sf_dir))


@query("""select img_path, case when event_id%3=0 then 7.0 when event_id%2=0 then 5.0 else t end as t from (select img_path, t_us/1e6 as t, cast(regexp_extract(img_path,'f([0-9]+)',1) as bigint) as event_id from plate_reading) q""")
def d_manifest(spark, sf_dir):
    """D7, D22."""
    r = _readings(spark, sf_dir).select("img_path", "t")
    n = F.regexp_extract("img_path", "f([0-9]+)", 1).cast("long")
    first = r.filter(n % 2 == 0).select("img_path", F.lit(5.0).alias("timestamp"), F.lit(0).alias("folder"))
    second = r.filter(n % 3 == 0).select("img_path", F.lit(7.0).alias("timestamp"), F.lit(1).alias("folder"))
    return plates.attach_manifest(r, plates.pool_directories(first, second))


# Speeds


def _entities(spark, sf_dir) -> DataFrame:
    df = view(spark, sf_dir, "video_entity").withColumn("raw_speed", F.col("raw_speed").cast("double"))
    return speed.relative_speed(df).withColumn("absolute_speed", F.lit(None).cast("double"))


CALIBRATED = """v as (select video, entity_id, direction, entity_type, cast(raw_speed as double)/max(cast(raw_speed as double)) over () as relative_speed from video_entity), ref as (select min(entity_id) as id from video_entity where direction='left'),
 c as (select *, case when direction='left' then relative_speed*(60/(select relative_speed from v where entity_id=(select id from ref))) end as absolute_speed from v)"""


def _calibrated(spark, sf_dir) -> DataFrame:
    df = _entities(spark, sf_dir)
    first = df.filter("direction = 'left'").agg(F.min("entity_id")).scalar()
    return speed.calibrate_speed(df, first, 60.0, direction="Left")


SUMMARY = """count(*) as n, count(distinct video) as videos, count(*) filter (direction='left') as n_left, count(*) filter (direction='right') as n_right, count(absolute_speed) as n_calibrated, round(avg(relative_speed),9) as mean_relative, round(median(relative_speed),9) as median_relative, round(avg(absolute_speed),6) as mean_absolute, round(median(absolute_speed),6) as median_absolute"""


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(f"""with {CALIBRATED} select 'all' as label, {SUMMARY} from c union all select case entity_type when 2 then 'car' when 1 then 'bicycle' when 0 then 'person' when 99 then 'unknown (99)' else 'unknown' end, {SUMMARY} from c group by 1 union all select video, {SUMMARY} from c group by 1""")
def e_speed_summary(spark, sf_dir):
    """C18, D14, E1-E3, E13, E14."""
    df = _calibrated(spark, sf_dir)
    every = speed.summarize_every(df).drop("kind")
    return _rounded(every, mean_relative=9, median_relative=9, mean_absolute=6, median_absolute=6)


@query("""select video, 'Report '||(row_number() over (order by video)) as label from (select distinct video from video_entity)""")
def d_report_labels(spark, sf_dir):
    """D17, F8."""
    reports = view(spark, sf_dir, "video_entity").select(F.col("video").alias("report")).distinct()
    none = spark.createDataFrame([], "pos int, label string")
    return speed.labels_to_reports(reports, none).withColumnRenamed("report", "video")


@query("""with g as (select video, pass_id, class_id, count(*) as n, min(frame_index) as f from detection group by all), t as (select video, pass_id, arg_min(class_id, (-n, f, class_id)) as entity_type from g group by 1,2),
 e as (select video, pass_id, min(frame_index) as a, max(frame_index) as b, arg_min(x,frame_index)+arg_min(w,frame_index)/2.0 as ax, arg_max(x,frame_index)+arg_max(w,frame_index)/2.0 as bx, arg_min(y,frame_index)+arg_min(h,frame_index)/2.0 as ay, arg_max(y,frame_index)+arg_max(h,frame_index)/2.0 as cy, count(*) as n from detection group by 1,2)
 select video, pass_id as entity_id, entity_type, a as first_frame, b as last_frame, n as boxes, case when bx>=ax then 'right' else 'left' end as direction, round(sqrt((bx-ax)*(bx-ax)+(cy-ay)*(cy-ay))/((b-a)/25.0),6) as raw_speed from e join t using (video, pass_id)""")
def e_track_entities(spark, sf_dir):
    """B38, B39, E12, F5."""
    return _rounded(speed.track_entities(view(spark, sf_dir, "detection").withColumnRenamed("pass_id", "track_id"), 25.0), raw_speed=6)


@query("""select video, frame_index, pass_id from (select *, row_number() over (partition by video, class_id order by w*h desc, frame_index, pass_id) as r from detection) where r=1""")
def f_best(spark, sf_dir):
    """F9."""
    df = view(spark, sf_dir, "detection")
    return speed.best_per_group(df, ["video", "class_id"], F.col("w") * F.col("h"), F.struct("frame_index", "pass_id")).select("video", "frame_index", "pass_id")


# Scoring


LABELS = ["left", "right", "front", "back", "unknown", "no_detection"]
TRUTH = """t as (select case event_id%6 when 0 then 'left' when 1 then 'right' when 2 then 'front' when 5 then 'back' end as truth, predicted from labeled_image), k as (select * from t where truth is not null)"""


def _pairs(spark, sf_dir) -> DataFrame:
    return scoring.read_labeled_images(view(spark, sf_dir, "labeled_image"), LABELS[:4]).select("truth", "predicted")


@query(f"""with {TRUTH} select truth, predicted, count(*) as n from k group by 1,2""")
def e_confusion(spark, sf_dir):
    """A12, E26."""
    return scoring.confusion_matrix(_pairs(spark, sf_dir))


@query(f"""with {TRUTH}, r as (select truth, count(*) as support, count(*) filter (truth=predicted) as tp from k group by 1), s as (select predicted as truth, count(*) as said from k group by 1), m as (select truth, support, tp, case when said>0 then tp/cast(said as double) else 0 end as p, tp/cast(support as double) as r from r left join s using (truth))
 select truth, support, tp, p as precision, r as recall, case when p+r>0 then 2*p*r/(p+r) else 0 end as f1 from m""")
def e_label_metrics(spark, sf_dir):
    """E27."""
    return scoring.label_metrics(_pairs(spark, sf_dir))


@query(f"""with {TRUTH} select label, (select count(*) from k where truth=label) as n_truth, (select count(*) from k where predicted=label) as n_predicted from (values ('left'),('right'),('front'),('back'),('unknown'),('no_detection')) v(label)""")
def e_label_counts(spark, sf_dir):
    """E28."""
    return scoring.label_counts(_pairs(spark, sf_dir), LABELS)


@query(f"""with {TRUTH} select count(*) as n, count(*) filter (truth=predicted) as correct, avg(case when truth=predicted then 1.0 else 0.0 end) as accuracy from k""")
def e_direction_benchmark(spark, sf_dir):
    """E29, G4."""
    images = view(spark, sf_dir, "labeled_image")
    boxes = images.filter("predicted <> 'no_detection'").select("name", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.lit(5).alias("w"), F.lit(5).alias("h"), F.lit("left").alias("label")), F.struct(F.lit(1).alias("idx"), F.lit(9).alias("w"), F.lit(9).alias("h"), F.col("predicted").alias("label")))).alias("b")).select("name", "b.*")
    return scoring.accuracy(scoring.direction_benchmark(images.select("name"), boxes, LABELS[:4]))


@query("""select l.label, count(d.class_id) as n from (values (2,'car'),(5,'bus'),(7,'truck')) l(class_id,label) left join detection d using (class_id) group by 1""")
def e_detection_totals(spark, sf_dir):
    """C1, E4."""
    return scoring.detection_totals(view(spark, sf_dir, "detection"), {2: "car", 5: "bus", 7: "truck"})


# Histograms


@query("""select direction, cast(label as timestamp) as label, bin, n, n/cast(sum(n) over (partition by direction,label) as double) as p from histogram""")
def e_row_distribution(spark, sf_dir):
    """E32."""
    return histograms.row_distribution(view(spark, sf_dir, "histogram")).withColumn("label", F.col("label").cast("timestamp_ntz"))


FULL = """full_ as (select a.direction, a.label, b.bin, coalesce(h.n,0) as n from (select distinct direction, label from histogram) a join (select distinct direction, bin from histogram) b using (direction) left join histogram h on h.direction=a.direction and h.label=a.label and h.bin=b.bin), pd as (select *, n/cast(sum(n) over (partition by direction,label) as double) as p from full_),
 pr as (select a.direction, a.bin, a.label as la, b.label as lb, a.n as na, b.n as nb, a.p as pa, b.p as pb from pd a join pd b on a.direction=b.direction and a.bin=b.bin and a.label<b.label),
 cmp as (select direction, la as label_a, lb as label_b, case when min(na)=max(na) or min(nb)=max(nb) then case when bool_and(na=nb) then 1.0 else 0.0 end else (count(*)*sum(na*nb)-sum(na)*sum(nb))/(sqrt(cast(count(*)*sum(na*na)-sum(na)*sum(na) as double))*sqrt(cast(count(*)*sum(nb*nb)-sum(nb)*sum(nb) as double))) end as pearson,
  sum(((case when pa>0 then pa*log2(pa/((pa+pb)/2)) else 0 end)+(case when pb>0 then pb*log2(pb/((pa+pb)/2)) else 0 end))/2) as js, sum(least(pa,pb)) as ov from pr group by 1,2,3)"""


@query(f"""with {FULL} select direction, cast(label_a as timestamp) as label_a, cast(label_b as timestamp) as label_b, round(pearson,6) as pearson, round(js,6) as js_divergence, round(ov,6) as overlap from cmp""")
def e_compare_histograms(spark, sf_dir):
    """D16, E33-E36."""
    out = histograms.compare_histograms(view(spark, sf_dir, "histogram"))
    return _rounded(out, pearson=6, js_divergence=6, overlap=6).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("label_a", "label_b")})


@query(f"""with {FULL}, v as (select direction, label, sum(p*bin*bin)-sum(p*bin)*sum(p*bin) as variance from pd group by 1,2), s as (select direction, avg(variance) as a, min(variance) as i, max(variance) as x from v group by 1)
 select direction, count(*) as pairs, count(*) filter (js<=0.1 and ov>=0.85) as within, round(max(js),6) as worst_js, round(any_value(a),6) as mean_variance, round(any_value(i),6) as min_variance, round(any_value(x),6) as max_variance, bool_and(js<=0.1 and ov>=0.85) as stable from cmp join s using (direction) group by 1""")
def e_stability(spark, sf_dir):
    """E32, E37, E40."""
    hist = view(spark, sf_dir, "histogram")
    pairs = histograms.compare_histograms(hist)
    out = histograms.stability_summary(pairs, histograms.row_variance(histograms.zero_filled(hist))).drop("worst_a", "worst_b")
    ok = pairs.groupBy("direction").agg(F.bool_and((F.col("js_divergence") <= 0.1) & (F.col("overlap") >= 0.85)).alias("stable"))
    return _rounded(out.join(ok, "direction"), worst_js=6, mean_variance=6, min_variance=6, max_variance=6)


@query(f"""with {FULL}, m as (select direction, bin, avg(p) as q from pd group by 1,2) select direction, cast(label as timestamp) as label, round(sum(((case when p>0 then p*log2(p/((p+q)/2)) else 0 end)+(case when q>0 then q*log2(q/((p+q)/2)) else 0 end))/2),6) as js_divergence, round(sum(least(p,q)),6) as overlap from pd join m using (direction,bin) group by 1,2""")
def e_report_match(spark, sf_dir):
    """E39."""
    hist = view(spark, sf_dir, "histogram")
    return _rounded(histograms.report_match(hist, hist).drop("passed"), js_divergence=6, overlap=6).withColumn("label", F.col("label").cast("timestamp_ntz"))


@query("""with l as (select *, dense_rank() over (partition by direction order by label desc) as r, dense_rank() over (partition by direction order by label)-1 as i from histogram), c as (select *, max(i) over (partition by direction)+1 as n from l)
 select 'last' as f, direction, cast(label as timestamp) as label, bin, n as k from (select direction,label,bin,r,histogram_n as n from (select direction,label,bin,r,n as histogram_n from l)) where r<=3
 union all select 'even', direction, cast(label as timestamp), bin, l.n from l where i in (select cast(round_even(k*(select max(i) from l l2 where l2.direction=l.direction)/4.0,0) as bigint) from range(5) t(k))""")
def f_rows(spark, sf_dir):
    """F6, F7."""
    hist = view(spark, sf_dir, "histogram")
    each = [df.select(F.lit(k).alias("f"), "direction", F.col("label").cast("timestamp_ntz").alias("label"), "bin", F.col("n").alias("k")) for k, df in (("last", histograms.last_n_rows(hist, 3)), ("even", histograms.evenly_spaced(hist, 5)))]
    return each[0].unionByName(each[1])


@query("""with v as (select cast(raw_speed as double)/max(cast(raw_speed as double)) over () as r from video_entity where entity_type=2), s as (select 20+(r-min(r) over ())/(max(r) over ()-min(r) over ())*80 as s from v), b as (select case when abs(s-20)<=abs(s-40) then 20 when abs(s-40)<=abs(s-60) then 40 when abs(s-60)<=abs(s-100) then 60 else 100 end as bin from s)
 select cast(g.bin as double) as bin, count(b.bin) as n from (values (20),(40),(60),(100)) g(bin) left join b using (bin) group by 1""")
def e_report_histogram(spark, sf_dir):
    """B32, B33, E38."""
    return histograms.report_histogram(_entities(spark, sf_dir), [20.0, 40.0, 60.0, 100.0], entity_type=2)


@query("""with d as (select cast(raw_speed as double) as v from video_entity), s as (select count(*) as n, min(v) as lo, max(v) as hi, quantile_cont(v,0.75)-quantile_cont(v,0.25) as iqr from d), w as (select lo, hi, least(2*iqr/cbrt(n), (hi-lo)/(2*sqrt(n)), (hi-lo)/(log2(n)+1)) as w from s), k as (select lo, hi, cast(ceil((hi-lo)/w) as bigint) as b from w), h as (select least(cast(floor((v-lo)/((hi-lo)/b)) as bigint), b-1) as bin, count(*) as n from d, k group by 1)
 select g.bin as bin, coalesce(h.n,0) as n from k, range(k.b) g(bin) left join h on h.bin=g.bin""")
def e_speed_histogram(spark, sf_dir):
    """E43."""
    df = view(spark, sf_dir, "video_entity").withColumn("v", F.col("raw_speed").cast("double"))
    return histograms.speed_histogram(df, "v").select("bin", "n")


@query("""with g as (select cast(max(t_us)-min(t_us) as double)/1e6 as dwell from plate_reading where plate_text is not null group by plate_text having count(*)>=2), s as (select min(dwell) as lo, max(dwell) as hi from g where dwell>0)
 select cast(least(floor((ln(dwell)-ln(lo*0.9))/(ln(hi*1.1)-ln(lo*0.9))*24),23) as int) as bin, count(*) as n from g, s where dwell>0 group by 1""")
def e_dwell_histogram(spark, sf_dir):
    """E44."""
    return histograms.dwell_histogram(plates.plate_dwell(_readings(spark, sf_dir)))


@query(f"""with {FULL}, q as (select *, lead(bin) over (partition by direction,label order by bin) as nb, lead(p) over (partition by direction,label order by bin) as np from pd), e as (select direction, cast(min(bin) as double) as lo, cast(max(bin) as double) as hi from pd group by 1), x as (select direction, i, hi, lo+(hi-lo)*i/239 as x from e, range(240) r(i))
 select q.direction, cast(q.label as timestamp) as label, i, round(x,6) as x, round(p+(np-p)*(x-bin)/(nb-bin),9) as y from q join x on q.direction=x.direction and nb is not null and x>=bin and (x<nb or (x=hi and nb=hi))""")
def e_ridgeline(spark, sf_dir):
    """E45."""
    return _rounded(histograms.ridgeline_points(view(spark, sf_dir, "histogram")), x=6, y=9).withColumn("label", F.col("label").cast("timestamp_ntz"))


# Occupancy


OCCUPANCY = """o as (select site, user_id as entity_id, min(t_us) as t, 1 as step from occupancy_event where event_type='signup' group by 1,2 union all select site, user_id, max(t_us), -1 from occupancy_event where event_type='purchase' group by 1,2),
 run as (select *, sum(case when step>0 then 1 else 0 end) over w as entered_total, sum(case when step<0 then 1 else 0 end) over w as exited_total from o window w as (partition by site order by t, step desc, entity_id rows unbounded preceding)),
 tl as (select site, t, entity_id, step, entered_total, exited_total, entered_total-exited_total + greatest(0,-min(entered_total-exited_total) over (partition by site)) as occupancy from run)"""


def _timeline(spark, sf_dir) -> DataFrame:
    seen = view(spark, sf_dir, "occupancy_event").select("site", F.when(F.col("event_type") == "signup", "entry").otherwise("exit").alias("side"), F.col("user_id").alias("entity_id"), F.col("t_us").alias("t"))
    return occupancy.running_occupancy(occupancy.entry_exit_events(seen))


@query(f"""with {OCCUPANCY} select * from tl""")
def f_occupancy(spark, sf_dir):
    """E46, F1-F3."""
    return _timeline(spark, sf_dir)


@query(f"""with {OCCUPANCY} select site, max(occupancy) as max_occupancy, count(*) filter (step>0) as total_entered, count(*) filter (step<0) as total_exited, count(distinct entity_id) as entities from tl group by 1""")
def e_occupancy_stats(spark, sf_dir):
    """E42."""
    return occupancy.occupancy_stats(_timeline(spark, sf_dir))


# Boxes: groups, riders, tracks


def _image_boxes(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "instance").select("image_id", (F.col("image_id") * 1_000_000_000 + F.col("entity_id")).alias("idx"), F.col("type_id").alias("class_id"), "x", "y", F.col("width").alias("w"), F.col("height").alias("h"), "entity_id")


IB = """ib as (select image_id, image_id*1000000000+entity_id as idx, type_id as class_id, x, y, width as w, height as h, entity_id from instance)"""
CLOSE = """a.image_id=b.image_id and a.x<=b.x+b.w+60 and b.x<=a.x+a.w+60 and a.y<=b.y+b.h+60 and b.y<=a.y+a.h+60 and greatest(a.w*a.h,b.w*b.h)<=2.5*least(a.w*a.h,b.w*b.h)"""


@query(f"""with recursive {IB}, e as (select a.idx as a, b.idx as b from ib a join ib b on {CLOSE}), reach as (select idx as a, idx as b from ib union select reach.a, e.b from reach join e on reach.b=e.a), c as (select a as idx, min(b) as cluster from reach group by 1)
 select image_id, cluster, min(x) as x, min(y) as y, max(x+w)-min(x) as w, max(y+h)-min(y) as h, count(*) as n, count(distinct class_id) as kinds from ib join c using (idx) group by 1,2""")
def i_box_clusters(spark, sf_dir):
    """B12, B13, D11, E41, I1."""
    return graph.cluster_boxes(graph.box_clusters(_image_boxes(spark, sf_dir))).select("image_id", "cluster", "x", "y", "w", "h", "n", F.size("classes").cast("long").alias("kinds"))


@query(f"""with recursive {IB}, e as (select a.idx as a, b.idx as b from ib a join ib b on {CLOSE}), reach as (select idx as a, idx as b from ib union select reach.a, e.b from reach join e on reach.b=e.a), c as (select a as idx, min(b) as cluster from reach group by 1)
 select entity_id, arg_max(cluster, image_id) as cluster from ib join c using (idx) group by 1""")
def i_assign_clusters(spark, sf_dir):
    """I6, K14."""
    boxes = graph.box_clusters(_image_boxes(spark, sf_dir)).withColumn("epoch_s", F.col("image_id") * 1800)
    return graph.assign_clusters(view(spark, sf_dir, "entity").select("entity_id", F.lit(None).cast("long").alias("cluster")), boxes)


@query(f"""with {IB}, p as (select b.image_id, b.idx as bike, q.idx as person from ib b join ib q on b.image_id=q.image_id and b.class_id in (1,3) and q.class_id=0 and (b.x+b.w/2.0-q.x-q.w/2.0)*(b.x+b.w/2.0-q.x-q.w/2.0)+(b.y-q.y-q.h/2.0)*(b.y-q.y-q.h/2.0) < (4*q.w/2.0)*(4*q.w/2.0)), t as (select image_id, person, min(bike) as bike from p group by 1,2),
 a as (select image_id, idx, x, y, w, h from ib where idx not in (select person from t) union all select t.image_id, t.bike, x, y, w, h from t join ib on ib.idx=t.person) select idx, min(x) as x, min(y) as y, max(x+w)-min(x) as w, max(y+h)-min(y) as h from a group by 1""")
def i_bikes(spark, sf_dir):
    """D19, I5."""
    return graph.merge_bikes_riders(_image_boxes(spark, sf_dir), 4.0).select("idx", "x", "y", "w", "h")


@query()
def i_track_frames(spark, sf_dir):
    """D10, I2."""
    return tracking.track_frames(view(spark, sf_dir, "detection"))


CATALOG_TRACKS = """r as (select i.*, m.epoch_s, row_number() over (partition by type_id order by m.epoch_s, i.image_id, i.entity_id) as k from instance i join image m using (image_id)),
 o as (select a.type_id, a.k, b.k as l, cast(greatest(0,least(a.x+a.width,b.x+b.width)-greatest(a.x,b.x))*greatest(0,least(a.y+a.height,b.y+b.height)-greatest(a.y,b.y)) as double) as common, a.width*a.height+b.width*b.height as areas from r a join r b on a.type_id=b.type_id and b.epoch_s<a.epoch_s and a.epoch_s-b.epoch_s<1801),
 g as (select type_id, k, list({'l': l, 'd': -common/(areas-common)}) as near from o where common>0 group by 1,2), c as (select *, row_number() over (partition by type_id order by k) as m from g),
 f as (select type_id, 0::bigint as m, 0::bigint as k, []::bigint[] as taken, []::struct(k bigint, root bigint)[] as roots, 0::bigint as root from (select distinct type_id from r) q
  union all select type_id, nm, nk, case when x is null then taken else list_append(taken, x.l) end, list_append(roots, {'k': nk, 'root': coalesce(x.root, nk)}), coalesce(x.root, nk) from
   (select f.*, c.m as nm, c.k as nk, list_sort(list_transform(list_filter(c.near, lambda n: not list_contains(f.taken, n.l)), lambda n: {'d': n.d, 'root': coalesce(list_filter(f.roots, lambda p: p.k=n.l)[1].root, n.l), 'l': n.l}))[1] as x from f join c on c.type_id=f.type_id and c.m=f.m+1) q),
 tracked as (select r.*, s.entity_id as new_id from r left join f on f.type_id=r.type_id and f.k=r.k join r s on s.type_id=r.type_id and s.k=coalesce(f.root, r.k))"""


@query(f"""with recursive {CATALOG_TRACKS}, m as (select new_id, min({{'e': epoch_s, 'i': image_id, 'x': x, 'y': y, 'w': width, 'h': height}}) as a, max({{'e': epoch_s, 'i': image_id, 'x': x, 'y': y, 'w': width, 'h': height}}) as b, count(*) as n from tracked group by 1)
 select new_id as entity_id, n, case when b.e>a.e then abs((b.x+b.w//2)-(a.x+a.w//2))/cast(b.e-a.e as double) else 0.0 end as raw_speed, case when n>1 then case when b.x+b.w/2.0>a.x+a.w/2.0 then 1 else -1 end end as direction_lr from m""")
def i_track_catalog(spark, sf_dir):
    """I3."""
    image, instance, _ = _catalog(spark, sf_dir)
    return tracking.track_motion(tracking.track_catalog(instance, image, 1801.0))


def _reidentified(name: str, where: str = "true") -> str:
    """{name}: camera, profile_id, t and ent of the profiles, one by one in order of time."""
    dot = lambda a, b: f"list_dot_product(cast({a}.embedding as double[]), cast({b}.embedding as double[]))"
    return f"""{name}p as (select camera, vec_id as profile_id, t, embedding, row_number() over (partition by camera order by t, vec_id) as i from profile where {where}),
 {name}s as (select a.camera, a.i, list({{'j': b.i, 's': {dot('a', 'b')}/(sqrt({dot('a', 'a')})*sqrt({dot('b', 'b')}))}}) as near from {name}p a left join {name}p b on a.camera=b.camera and b.i<a.i and b.t>=a.t-500 group by 1,2),
 {name}f as (select camera, 0::bigint as i, []::bigint[] as ents, 0::bigint as n, 0::bigint as ent from (select distinct camera from {name}p) q
  union all select camera, k, list_append(ents, new), greatest(n, new), new from
   (select *, case when a is not null and -a.d>=0.3 and (b is null or -b.d<=-1 or greatest(1+a.d,1e-6)/greatest(1+b.d,1e-6)<=0.99) then a.e else n+1 end as new from
    (select *, r[1] as a, list_filter(r, lambda x: x.e<>r[1].e)[1] as b from
     (select f.*, s.i as k, list_sort(list_transform(list_filter(s.near, lambda x: x.j is not null), lambda x: {{'d': -x.s, 'e': f.ents[x.j]}})) as r from {name}f f join {name}s s on s.camera=f.camera and s.i=f.i+1) q) q) q),
 {name} as (select p.camera, p.profile_id, p.t, f.ent from {name}f f join {name}p p on p.camera=f.camera and p.i=f.i)"""


@query(f"with recursive {_reidentified('found')} select camera, profile_id, t, ent as entity_id from found")
def i_reidentify(spark, sf_dir):
    """I4."""
    return tracking.reidentify(_features(spark, sf_dir), 0.3, 0.99, 500.0).drop("feature")


def _features(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "profile").select("camera", F.col("vec_id").alias("profile_id"), "t", F.col("embedding").alias("feature"))


@query(f"with recursive {_reidentified('found')} select camera, profile_id, t, ent as entity_id, count(*) over w as sightings, min(t) over w as first_t, max(t) over w as last_t from found window w as (partition by camera, ent)")
def i_profile(spark, sf_dir):
    """I11."""
    return reports.run_profile(_features(spark, sf_dir), threshold=0.3, ratio=0.99, max_gap=500.0)


@query(f"""with recursive {_reidentified('came', '(vec_id//4)%2=0')}, {_reidentified('went', '(vec_id//4)%2=1')},
 o as (select camera as site, ent as entity_id, min(t) as t, 1 as step from came group by 1,2 union all select camera, ent, max(t), -1 from went group by 1,2),
 run as (select *, sum(case when step>0 then 1 else 0 end) over w as entered_total, sum(case when step<0 then 1 else 0 end) over w as exited_total from o window w as (partition by site order by t, step desc, entity_id rows unbounded preceding))
 select site, t, entity_id, step, entered_total, exited_total, entered_total-exited_total + greatest(0,-min(entered_total-exited_total) over (partition by site)) as occupancy from run""")
def i_occupancy(spark, sf_dir):
    """I8: profiles are seen at the entry and the exit in turn."""
    p = _features(spark, sf_dir).withColumn("side", (F.col("profile_id") / 4).cast("long") % 2)
    entry, exit_ = (p.filter(F.col("side") == k).drop("side") for k in (0, 1))
    return reports.run_occupancy(entry, exit_, threshold=0.3, ratio=0.99, max_gap=500.0)[0]


@query("""with s as (select a.vec_id as d_id, b.label as g_entity, max(case when a.vec_id=b.vec_id then -1 else list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) end) as similarity from profile a join profile b on a.camera=b.camera group by 1,2),
 r as (select *, row_number() over (partition by d_id order by similarity desc, g_entity) as r, lead(similarity) over (partition by d_id order by similarity desc, g_entity) as second from s)
 select d_id, g_entity, round(similarity,6) as similarity from r where r=1 and similarity>=0.2 and (second is null or second<=-1 or greatest(1-similarity,1e-6)/greatest(1-second,1e-6)<=0.95)""")
def g_best_match(spark, sf_dir):
    """D20, G6 of every profile against all others of its camera, at any time."""
    p = view(spark, sf_dir, "profile")
    side = lambda s: p.select(F.col("camera").alias(f"{s}_camera"), F.col("vec_id").alias(f"{s}_id"), F.col("label").alias(f"{s}_entity"), F.col("embedding").alias(f"{s}_v"))
    near = similarity.nearest_entities(side("d"), side("g"), similarity.decisive(0.2, 0.95))
    return _rounded(tracking.best_match(near, 0.2, 0.95), similarity=6)


@query("""with s as (select a.vec_id as d_id, b.label as g_entity, max(case when a.vec_id=b.vec_id then -1 else list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) end) as similarity from profile a join profile b on a.camera=b.camera and abs(a.t-b.t)<=400 group by 1,2),
 r as (select *, row_number() over (partition by d_id order by similarity desc, g_entity) as r, lead(similarity) over (partition by d_id order by similarity desc, g_entity) as second from s)
 select d_id, g_entity, round(similarity,6) as similarity from r where r=1 and similarity>=0.1 and (second is null or second<=-1 or greatest(1-similarity,1e-6)/greatest(1-second,1e-6)<=0.98)""")
def g_best_match_all(spark, sf_dir):
    """D20, G6 of every profile against all others within a time."""
    p = view(spark, sf_dir, "profile")
    side = lambda s: p.select(F.col("camera").alias(f"{s}_camera"), F.col("t").alias(f"{s}_t"), F.col("vec_id").alias(f"{s}_id"), F.col("label").alias(f"{s}_entity"), F.col("embedding").alias(f"{s}_v"))
    other = F.when(F.col("d_id") == F.col("g_id"), -1.0).otherwise(vectors.cosine(F.col("d_v"), F.col("g_v")))
    return _rounded(tracking.best_match(tracking.similarity_candidates(side("d"), side("g"), other, 400), 0.1, 0.98), similarity=6)


def _matched(spark, sf_dir) -> DataFrame:
    cars = view(spark, sf_dir, "gt_car").withColumn("t", F.col("cross_cs") / 100)
    tracks = view(spark, sf_dir, "gt_track").withColumn("t", F.col("last_cs") / 100)
    pairs = tracking.nearest_time_match(cars, tracks, 0.5)
    return pairs.join(cars.drop("t"), ["recording", "car_id"]).join(tracks.drop("t"), ["recording", "track_id"])


NEAREST = """cars as (select recording, car_id, cross_cs, row_number() over (partition by recording order by cross_cs, car_id) as i from gt_car),
 c as (select recording, i, list({'d': d, 'track': track_id} order by d, track_id) as near from (select cars.recording, i, abs(last_cs/100.0-cross_cs/100.0) as d, track_id from cars left join gt_track t on t.recording=cars.recording and last_cs/100.0>=cross_cs/100.0-0.5 and last_cs/100.0<=cross_cs/100.0+0.5) q group by 1,2),
 f as (select recording, 0 as i, [0]::bigint[] as taken, 0::bigint as track from (select distinct recording from cars) q
  union all select f.recording, c.i, case when x is null then f.taken else list_append(f.taken, x) end, x from (select f.*, c.i as j, list_filter(c.near, lambda n: n.track is not null and not list_contains(f.taken, n.track))[1].track as x from f join c on c.recording=f.recording and c.i=f.i+1) f join c on c.recording=f.recording and c.i=f.j)"""


@query(f"with recursive {NEAREST} select cars.recording, car_id, track as track_id from f join cars on cars.recording=f.recording and cars.i=f.i where track is not null and f.i>0")
def d_nearest_match(spark, sf_dir):
    """D13."""
    return _matched(spark, sf_dir).select("recording", "car_id", "track_id")


@query(f"""with recursive {NEAREST}, m as (select cars.car_id, speed_kmh, pixel_speed from f join cars on cars.recording=f.recording and cars.i=f.i join gt_car g on g.recording=f.recording and g.car_id=cars.car_id join gt_track t on t.recording=f.recording and t.track_id=f.track where f.i>0 and g.valid),
 e as (select speed_kmh, pixel_speed*(select arg_min(speed_kmh,car_id) from m)/(select arg_min(pixel_speed,car_id) from m) as estimate from m where car_id<>(select min(car_id) from m)), d as (select abs(estimate-speed_kmh) as a, abs(estimate-speed_kmh)/speed_kmh as r from e)
 select count(*) as n, round(avg(a),6) as mean_abs, round(median(a),6) as median_abs, round(sqrt(avg(a*a)),6) as rmse, round(avg(r),6) as mean_relative, round(avg(case when r<=0.2 then 1.0 else 0.0 end),6) as reasonable, count(*) filter (r<=0.05) as n_0, count(*) filter (r>0.05 and r<=0.2) as n_1, count(*) filter (r>0.2 and r<=0.5) as n_2, count(*) filter (r>0.5) as n_3 from d""")
def e_speed_benchmark(spark, sf_dir):
    """E30, E31."""
    df = _matched(spark, sf_dir).filter("valid")
    ref = df.agg(F.min(F.struct("car_id", "speed_kmh", "pixel_speed")).alias("r"))
    scored = df.crossJoin(F.broadcast(ref)).filter("car_id <> r.car_id").select("speed_kmh", (F.col("pixel_speed") * F.col("r.speed_kmh") / F.col("r.pixel_speed")).alias("estimate"))
    return _rounded(speed.speed_accuracy(scored), **dict.fromkeys(("mean_abs", "median_abs", "rmse", "mean_relative", "reasonable"), 6))


@query(f"""with {IB}, s as (select a.image_id, a.idx, cast(greatest(0,least(a.x+a.w,900)-greatest(a.x,500))*greatest(0,least(a.y+a.h,700)-greatest(a.y,300)) as double) as i, a.w*a.h as area from ib a), q as (select image_id, idx, i/(area+160000-i) as iou, row_number() over (partition by image_id order by i/(area+160000-i) desc, idx) as r from s) select image_id, idx, round(iou,9) as iou from q where r=1""")
def d_reference_box(spark, sf_dir):
    """B6, D21."""
    boxes = _image_boxes(spark, sf_dir).withColumn("label", F.lit("left"))
    known = boxes.select("image_id").distinct().select("image_id", *[F.lit(v).alias(c) for v, c in zip((500, 300, 400, 400), "xywh")])
    return _rounded(tracking.match_reference_box(boxes, known).drop("label"), iou=9)


@query("""with recursive s as (select video, frame_index, count(*) filter (class_id=7) as n, row_number() over (partition by video order by frame_index) as i from detection where frame_index%2=0 group by 1,2),
 f as (select video, i, frame_index, true as kept, case when n=0 then 3 else 0 end as rest from s where i=1
  union all select s.video, s.i, s.frame_index, f.rest=0, case when f.rest>0 then f.rest-1 when s.n=0 then 3 else 0 end from f join s on s.video=f.video and s.i=f.i+1)
 select video, frame_index from f where kept""")
def c_adaptive(spark, sf_dir):
    """C4."""
    frames = view(spark, sf_dir, "detection").groupBy("video", "frame_index").agg(F.count_if(F.col("class_id") == 7).alias("detections"))
    return filters.adaptive_downsample(frames, 2, 3)


# Rows that go on from others: sets, write-backs, composed analyses


@query("""select i.image_id, count(*) as n, cast(sum(raw_c) as bigint) as raw_c, count(distinct cluster) as clusters from instance i join entity e using (entity_id) group by 1""")
def d_image_entities(spark, sf_dir):
    """D2."""
    _, instance, entity = _catalog(spark, sf_dir)
    return catalog.image_entities(instance, entity).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("raw_c").alias("raw_c"), F.count_distinct("cluster").alias("clusters"))


@query("""with d as (select *, row_number() over (order by video, frame_index, x, y, w, h, class_id)-1 as id from detection), p as (select a.id as l, b.id as r, b.frame_index as time, cast(greatest(0,least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*greatest(0,least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)) as double) as common, a.w*a.h+b.w*b.h as areas from d a join d b on a.video=b.video and b.frame_index between a.frame_index+1 and a.frame_index+2)
 select time, count(*) as n, round(sum(common/(areas-common)),6) as iou from p where common/(areas-common)>=0.15 group by 1""")
def d_iou_candidates(spark, sf_dir):
    """Pairs two frames apart at most, by frame."""
    return tracking.iou_by_frame(view(spark, sf_dir, "detection"), 2).withColumn("iou", F.round("iou", 6))


@query("""with r as (select plate_text, t_us, t_us-lag(t_us) over (partition by plate_text order by t_us)>=86400000000 as fresh from plate_reading where plate_text is not null), s as (select plate_text, t_us, count(*) filter (fresh) over (partition by plate_text order by t_us range between unbounded preceding and current row) as segment from r)
 select plate_text, segment, count(*) as n, min(t_us) as first_us, max(t_us) as last_us from s group by 1,2""")
def f_segments(spark, sf_dir):
    """I7."""
    r = view(spark, sf_dir, "plate_reading").filter("plate_text is not null").select("plate_text", "t_us")
    return tracking.segment_by_gap(r, ["plate_text"], "t_us", 86_400_000_000).groupBy("plate_text", "segment").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("""select predicted as label, count(*) as n from labeled_image group by 1""")
def e_direction_totals(spark, sf_dir):
    """E5."""
    return scoring.direction_totals(view(spark, sf_dir, "labeled_image").withColumnRenamed("predicted", "label"))


@query(f"""with {OCR} select truth, count(*) as n from rows where coalesce(truth,'')<>'' group by 1""")
def c_usable_plates(spark, sf_dir):
    """C20."""
    return filters.usable_plates(_scored(spark, sf_dir)).groupBy("truth").agg(F.count("*").alias("n"))


@query("""select * from detection where class_id=2 and cast((frame_index*7)%100 as double)/100>=0.4""")
def c_confident(spark, sf_dir):
    """C1 with a confidence."""
    scored = view(spark, sf_dir, "detection").withColumn("confidence", (F.col("frame_index") * 7 % 100).cast("double") / 100)
    return filters.keep_confident(filters.keep_classes(scored, (2,)), 0.4).drop("confidence")


@query("""select distinct plate_text as key from plate_reading where plate_text is not null union select distinct truth from plate_reading union select distinct video from detection""")
def e_all_groups(spark, sf_dir):
    """H3: the keys that any of some counters has."""
    r = view(spark, sf_dir, "plate_reading")
    counters = [df.groupBy(F.col(c).alias("key")).count() for df, c in ((r.filter("plate_text is not null"), "plate_text"), (r, "truth"), (view(spark, sf_dir, "detection"), "video"))]
    return filters.all_groups("key", *counters)


@query("""with a as (select image_id, list(distinct type_id) filter (confidence>=0.5) as sure, list(distinct type_id) as every from instance group by 1)
 select image_id, coalesce(len(sure),0)=len(every) as same from a""")
def e_same_members(spark, sf_dir):
    """H4: whether the types surely seen in an image are all that were seen there."""
    _, instance, _ = _catalog(spark, sf_dir)
    types = instance.groupBy("image_id").agg(F.collect_set(F.when(F.col("confidence") >= 0.5, F.col("type_id"))).alias("sure"), F.collect_set("type_id").alias("every"))
    return types.select("image_id", filters.same_members(F.col("sure"), F.col("every")).alias("same"))


@query("""with p as (select image_id, entity_id, min((entity_id*3+image_id)%4) as pose from instance where image_id%2=0 group by 1,2)
 select i.image_id, i.entity_id, case when type_id in (0,1) and pose is not null then pose-1 else i.direction_lr end as direction_lr, case when type_id in (0,1) and pose is not null then 1-pose else i.direction_fb end as direction_fb, case when i.entity_id%3=0 then 7 else cluster end as cluster, case when i.entity_id%3=0 then i.entity_id/4.0 end as speed
 from instance i left join p using (image_id, entity_id) left join entity e using (entity_id)""")
def k_write_back(spark, sf_dir):
    """Directions of poses, clusters and speeds of entities, written back."""
    _, instance, entity = _catalog(spark, sf_dir)
    pose = (F.col("entity_id") * 3 + F.col("image_id")) % 4
    poses = instance.filter("image_id % 2 = 0").select("image_id", "entity_id", F.explode(F.array(pose, pose + 4)).alias("pose")).withColumns({"direction_lr": (F.col("pose") - 1).cast("int"), "direction_fb": (1 - F.col("pose")).cast("int")})
    found = entity.filter("entity_id % 3 = 0").select("entity_id", F.lit(7).cast("long").alias("cluster"), (F.col("entity_id") / 4).alias("speed"))
    entity = catalog.set_columns(entity.select("entity_id", F.col("cluster").cast("long").alias("cluster"), F.lit(None).cast("double").alias("speed")), found, "entity_id")
    turned = catalog.set_direction(instance, poses).select("image_id", "entity_id", *[F.col(c).cast("int").alias(c) for c in ("direction_lr", "direction_fb")])
    return turned.join(entity, "entity_id", "left").select("image_id", "entity_id", "direction_lr", "direction_fb", "cluster", "speed")


@query("""with r as (select upper(plate_text) as plate_text, case when cast(regexp_extract(img_path,'f([0-9]+)',1) as bigint)%2=0 then 5.0 else t_us/1e6 end as t from plate_reading), m as (select plate_text, max(t)-min(t) as dwell, count(*) as n from r where length(plate_text)>1 group by 1 having count(*)>=2)
 select (select count(*) from r) as images, (select count(*) from r where length(plate_text)>1) as plates_read, (select count(*) from m) as matched, (select count(*) from r where length(plate_text)>1)-(select sum(n) from m) as single_sightings, round((select avg(dwell) from m where dwell>=1000),3) as average_dwell, (select count(*) from m where dwell<1000) as excluded""")
def i_plate_dwell(spark, sf_dir):
    """The composed analysis over two directories, one of which has a manifest of times."""
    r = _readings(spark, sf_dir).select("img_path", "plate_text", "t")
    even = F.regexp_extract("img_path", "f([0-9]+)", 1).cast("long") % 2 == 0
    manifest = r.filter(even).select("img_path", F.lit(5.0).alias("timestamp"), F.lit(0).alias("folder"))
    _, stats = reports.run_plate_dwell([r.filter(even), r.filter(~even)], manifest, least_dwell=1000.0)
    return stats.select("images", "plates_read", "matched", "single_sightings", F.round("average_dwell", 3).alias("average_dwell"), "excluded")


@query(RAW["e_crossing_summary"])
def i_plate_dwell_benchmark(spark, sf_dir):
    """The composed benchmark."""
    _, summary = reports.run_plate_dwell_benchmark(_readings(spark, sf_dir), 1, 2_400_000)
    return summary.withColumn("mean_abs_delta", F.round("mean_abs_delta", 3))


@query(f"""with {CALIBRATED} select (select count(distinct video) from video_entity) as videos, count(*) as entities, count(*) filter (direction='left') as n_left, count(*) filter (direction='right') as n_right, (select count(distinct split_part(img_path,'/',1)) from plate_reading) as plate_videos, (select count(distinct img_path) from plate_reading) as plates from c""")
def e_tool_stats(spark, sf_dir):
    """extraction_stats and track_stats."""
    manifest = _readings(spark, sf_dir).select("img_path", F.split_part("img_path", F.lit("/"), F.lit(1)).alias("source_video"))
    plates_ = plates.extraction_stats(manifest).select(F.col("videos").alias("plate_videos"), F.col("plates").alias("plates"))
    return speed.track_stats(view(spark, sf_dir, "video_entity")).crossJoin(plates_)


@query("""select e.event_id, round(0.5*user_id+0.25*(event_id%100)-value,6) as score from events e""")
def l_score_batches(spark, sf_dir):
    """L1: a user's model over batches, here a linear one."""

    def load():
        return 0.5, 0.25

    def score(model, batch):
        a, b = model
        return batch[["event_id"]].assign(score=(a * batch["user_id"] + b * (batch["event_id"] % 100) - batch["value"]).round(6))

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("value").cast("double").alias("value"))
    return readers.score_batches(events, load, score, "event_id long, score double")


from parkflow.plans import exchange  # noqa: E402, F401  (registers the queries over files and streams)
