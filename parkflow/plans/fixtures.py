"""Views in the shape of the engine's inputs, derived from the given tables.

One text serves both engines: $US is a timestamp in microseconds, $DIV integer division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "orders", "lineitem", "embeddings")

VIEWS = {
    "image": """select distinct $US $DIV 1800000000 as image_id, ($US $DIV 1800000000)*1800 as epoch_s,
        ($US $DIV 1800000000) % 7 <> 0 as analyzed from events""",
    "instance": """select image_id, entity_id, type_id, x, y, width, height, confidence, direction_lr, direction_fb from (
        select $US $DIV 1800000000 as image_id, user_id as entity_id,
          case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 else 5 end as type_id,
          (event_id*37+user_id*11)%1800 as x, (event_id*53)%1000 as y, 20+(event_id*7)%120 as width, 20+(event_id*13)%160 as height,
          cast((event_id*31)%100 as double)/100 as confidence,
          case event_id%4 when 0 then -1 when 1 then 1 when 2 then 0 end as direction_lr,
          case event_id%5 when 0 then -1 when 1 then 1 when 2 then 0 end as direction_fb,
          row_number() over (partition by $US $DIV 1800000000, user_id order by event_id) as rn from events) q where rn=1""",
    "entity": """select user_id as entity_id, case when user_id%10=9 then null else user_id%40 end as cluster,
        sum(cast(round(value*100) as bigint)) as raw_c from events group by user_id""",
    "plate_reading": """select truth, case when event_id%23=0 then null when event_id%17=0 then concat(substr(truth,1,5),'X') else truth end as plate_text,
        t_us, img_path from (
        select event_id, lpad(cast((user_id*7919+13)%999983 as varchar(10)),6,'0') as truth, $US as t_us,
          concat('cam',cast(event_id%2 as varchar(1)),'/f',cast(event_id as varchar(12)),'.jpg') as img_path from events) q""",
    "detection": """select concat('v',cast(o_custkey%20 as varchar(3)),'.mp4') as video, (o_orderkey*13)%3000 + i as frame_index,
        500+(o_orderkey*7)%900 + (case when o_orderkey%2=0 then -1 else 1 end)*(3+o_orderkey%8)*i as x,
        (o_orderkey*97)%900 as y, 40+o_orderkey%30 as w, 30+o_orderkey%25 as h,
        case when (o_orderkey+i)%9=0 then 7 else 2 end as class_id, o_orderkey as pass_id from $ORDERS_FRAMES""",
    "video_entity": """select concat('v',cast(o_custkey%12 as varchar(3)),'.mp4') as video, o_orderkey as entity_id,
        case when o_orderkey%2=0 then 'left' else 'right' end as direction,
        case o_orderkey%6 when 0 then 2 when 1 then 1 when 2 then 0 when 3 then 2 when 4 then null else 99 end as entity_type,
        o_totalprice as raw_speed from orders""",
    "histogram": """select l_returnflag as direction, date_trunc('quarter',l_shipdate) as label, cast(floor(l_quantity/5)*5 as int) as bin, count(*) as n
        from lineitem group by 1,2,3""",
    "profile": """select vec_id%4 as camera, vec_id, vec_id*5 as t, 5+vec_id%10 as ar10, label, embedding from embeddings""",
    "occupancy_event": """select user_id%5 as site, event_type, $US as t_us, user_id from events where event_type in ('signup','purchase')""",
    "gt_car": """select concat('r',cast(o_custkey%10 as varchar(3))) as recording, o_orderkey as car_id, o_orderkey%7<>0 as valid,
        30+o_orderkey%60 as speed_kmh, (o_orderkey*131)%200000 as cross_cs from orders""",
    "gt_track": """select concat('r',cast(o_custkey%10 as varchar(3))) as recording, o_orderkey as track_id,
        (o_orderkey*131)%200000 + (o_orderkey%5-2)*40 as last_cs, (30+o_orderkey%60)*9 + o_orderkey%11 as pixel_speed
        from orders where o_orderkey%8<>3""",
    "keypoint": """select event_id, i, (event_id*(i+3)*7)%640 as kx, (event_id*(i+5)*3)%480 as ky, cast((event_id+i*29)%100 as double)/100 as conf from $EVENTS_POINTS""",
    "labeled_image": """select concat('cam',cast(user_id as varchar(8)),
          case event_id%6 when 0 then '_left_' when 1 then '-right-' when 2 then '_front.' when 3 then '_leftover_'
               when 4 then '_left_right_' else '_back_' end, cast(event_id as varchar(12)),'.JPG') as name,
        case (event_id + event_id $DIV 7)%6 when 0 then 'left' when 1 then 'right' when 2 then 'front'
             when 3 then 'no_detection' when 4 then 'unknown' else 'back' end as predicted, event_id from events""",
    "clock_text": """select event_id, case event_id%4 when 0 then $FMT1 when 1 then $FMT2 when 2 then $FMT3 else 'n/a' end as txt from events""",
}
SPARK = {"$US": "unix_micros(cast(ts as timestamp))", "$DIV": "div", "$ORDERS_FRAMES": "orders lateral view explode(sequence(0,11)) e as i", "$EVENTS_POINTS": "events lateral view explode(sequence(0,16)) e as i", "$FMT1": "date_format(ts,'yyyy-MM-dd HH:mm:ss')", "$FMT2": "date_format(ts,'MM/dd/yyyy HH:mm:ss')", "$FMT3": "date_format(ts,'HH.mm.ss')"}
DUCK = {"$US": "epoch_us(ts)", "$DIV": "//", "$ORDERS_FRAMES": "orders, range(0,12) r(i)", "$EVENTS_POINTS": "events, range(0,17) r(i)", "$FMT1": "strftime(ts,'%Y-%m-%d %H:%M:%S')", "$FMT2": "strftime(ts,'%m/%d/%Y %H:%M:%S')", "$FMT3": "strftime(ts,'%H.%M.%S')"}


def _for(tokens: dict[str, str], text: str) -> str:
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the Parquet tables in sf_dir."""
    text = _for(SPARK, VIEWS[name])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    for t in used:
        text = re.sub(rf"\b{t}\b", "{" + t + "}", text)
    return spark.sql(text, **used)


def with_views(body: str) -> str:
    """DuckDB SQL in which the views that `body` names are defined."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    head = ",\n".join(f"{n} as ({_for(DUCK, VIEWS[n])})" for n in used)
    if not head:
        return body
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head},\n{body[15:]}"
    return f"with {head},\n{body[5:]}" if body.lower().startswith("with ") else f"with {head}\n{body}"
