"""One query for each operator, over the driver's tables, with the SQL that an oracle runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.catalog import LANE_DIRECTIONS
from roadloom.functions import geo, scalars
from roadloom.operators import align, clean, dedup, features, fuzzy, layer, review, snap, tracker, tracks, turns
from roadloom.params import DEFAULT
from roadloom.plans.views import DET_SQL, ROADS_SQL, detections, placed, road_ways, table
from roadloom.tables import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


KEYS = ["drive_id", "name_sign"]


def _tracker_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("drive_id", F.col("frame").cast("long").alias("frame"), "det_id", "name_sign", "number_sign", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "w", "h", "is_side", "course", "car_e", "car_n", "lat", "lon")


@query()
def track_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful tracker, a fold over each drive."""
    t = tracker.track(_tracker_input(spark, sf_dir))
    return t.select("drive_id", "track_id", "name_sign", "number_sign", "mode_count", "observations", "is_side", "is_left", F.round("azimuth", 6).alias("azimuth"), "first_frame", "last_frame")


@query()
def track_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections to features: track, snap, slots, lines, dedup. The flagship; sign_layer goes on to stored features."""
    t = checkpointed(tracker.track(_tracker_input(spark, sf_dir)))  # read by the snap and by the lines
    segs = snap.segments(road_ways(spark, sf_dir))
    at = t.withColumn("point_id", F.concat_ws("/", "drive_id", "track_id"))
    near = snap.snap(at.select("point_id", "lat", "lon"), segs).select("point_id", "snapped", "road_azimuth")
    t = at.join(near, "point_id").withColumn("azimuth", F.when(F.col("snapped"), F.col("road_azimuth")).otherwise(F.col("azimuth")))
    made = features.lines(features.slots(t, ["drive_id", "track_id"]))
    e, n = geo.to_utm(F.col("lat1"), F.col("lon1"))
    flat = made.select(F.shiftleft("drive_id", 32).bitwiseOR(F.col("track_id")).alias("seq"), F.col("number_sign").alias("type"), "is_left", e.alias("e"), n.alias("n"), "azimuth", F.col("observations").alias("length"), "drive_id", "track_id", "slot", "lat1", "lon1", "lat2", "lon2")
    return dedup.grid_dedup(checkpointed(flat)).select("drive_id", "track_id", "type", "is_left", "slot", "length", *[F.round(c, 6).alias(c) for c in ("azimuth", "lat1", "lon1", "lat2", "lon2")])


@query(f"""with {DET_SQL}, p as (select drive_id, frame - 1 as idx, course, lat, lon from det), l as (select drive_id, max(idx) as last from p group by 1),
f as (select drive_id, det_id, frame * 40 as abs_frame, greatest(0, cast(floor((frame * 40 - 1) / 6e1) as bigint)) as gps_index from det)
select f.drive_id, f.det_id, f.abs_frame, f.gps_index, a.lat, a.lon, b.course as next_course from f join l using (drive_id)
left join p a on a.drive_id = f.drive_id and a.idx = least(gps_index + 1, last) left join p b on b.drive_id = f.drive_id and b.idx = least(gps_index + 2, last)""")
def gps_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    gps = det.select("drive_id", (F.col("frame") - 1).cast("long").alias("idx"), "lat", "lon", "course")
    frames = det.select("drive_id", "det_id", (F.col("frame") * 40).alias("abs_frame"))
    one = align.align(frames, gps).drop("course")
    two = align.align(frames, gps, ahead=2).select("det_id", F.col("course").alias("next_course"))
    return one.join(two, "det_id").select("drive_id", "det_id", "abs_frame", "gps_index", "lat", "lon", "next_course")


@query(f"""with {DET_SQL} select det_id, drive_id, speed, case when speed <> 0 then greatest(2, cast(round_even(-0.5e0 * speed + 10.9e0, 0) as int)) end as step from det where speed >= 2 and frame % 5 = 0""")
def adaptive_sample_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = detections(spark, sf_dir).withColumnRenamed("frame", "frame_number")
    return align.moving(align.every_nth(f, 5)).select("det_id", "drive_id", "speed", scalars.adaptive_step(F.col("speed")).alias("step"))


@query(f"""with recursive {DET_SQL}, f as (select *, case when speed <> 0 then greatest(2, cast(round_even(-0.5e0 * speed + 10.9e0, 0) as int)) else 0 end as wanted from det),
r as (select drive_id, det_id, frame, speed, 1 as since, 5 as step, false as taken from f where frame = 1
 union all select f.drive_id, f.det_id, f.frame, f.speed, case when since + 1 >= step then 0 else since + 1 end, case when since + 1 >= step and f.speed >= 2 and wanted > 0 then wanted else step end, since + 1 >= step from r join f on f.drive_id = r.drive_id and f.frame = r.frame + 1)
select drive_id, frame as frame_number, det_id, speed from r where taken""")
def adaptive_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = detections(spark, sf_dir).select("drive_id", F.col("frame").alias("frame_number"), "det_id", "speed")
    return align.adaptive_frames(f)


@query(f"""with {DET_SQL}, pairs as (select a.det_id as i, b.det_id as j, a.w * a.h as s, b.w * b.h as t,
 greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) * 1e2 / (a.w * a.h) as part
 from det a join det b on a.drive_id = b.drive_id and a.scene_id = b.scene_id and a.name_sign = b.name_sign and a.det_id < b.det_id),
gone as (select distinct case when s < t then i else j end as det_id from pairs where part > 40)
select det_id, drive_id, scene_id, name_sign from det where det_id not in (select det_id from gone)""")
def inframe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.inframe_dedup(detections(spark, sf_dir), "scene_id").select("det_id", "drive_id", "scene_id", "name_sign")


@query(f"""with {DET_SQL} select det_id, drive_id, case name_sign when 'click' then '7.13.1' else name_sign end as name_sign from det where name_sign <> 'view' and w > 0 and h > 0 and speed >= 20""")
def clean_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds, then dropped and renamed classes; two event types stand for the classes concerned."""
    d = detections(spark, sf_dir)
    raw = d.withColumns({"box_confidence": F.col("speed") / 40, "coarse_confidence": F.lit(1.0), "name_sign": F.when(F.col("name_sign") == "click", "7.13").when(F.col("name_sign") == "view", "5.16.2").otherwise(F.col("name_sign"))})
    return clean.normalise_classes(clean.confident(raw)).select("det_id", "drive_id", "name_sign")


@query(f"""with {DET_SQL}, c as (select drive_id, name_sign, number_sign, count(*) as n, min(frame) as f from det group by 1, 2, 3),
r as (select *, row_number() over (partition by drive_id, name_sign order by n desc, f) as k from c),
o as (select drive_id, name_sign, count(*) as observations, sum(case when is_side then 1 else 0 end) * 2 > count(*) as is_side from det group by 1, 2)
select drive_id, name_sign, number_sign as best, n as best_count, observations, is_side from r join o using (drive_id, name_sign) where k = 1""")
def track_mode_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    return tracks.mode_vote(det, KEYS, "number_sign", "frame").join(tracks.observations(det, KEYS), KEYS)


@query(f"""with {DET_SQL}, c as (select drive_id, name_sign, number_sign, count(*) as n from det group by 1, 2, 3), m as (select drive_id, name_sign, max(n) as m from c group by 1, 2),
s as (select drive_id, name_sign, count(*) as n, case when count(*) < 2 then 0.5 else greatest(0, 1 - stddev_pop(x) / 150) end as track from det group by 1, 2),
z as (select drive_id, name_sign, abs(arg_min(course, frame) - arg_max(course, frame)) as d from det group by 1, 2),
p as (select drive_id, name_sign, m.m / cast(s.n as double) as share, track, 0.3e0 * track + 0.25e0 * greatest(0, least(1, (s.n - 4) / 16e0)) + 0.25e0 * (1 - ((drive_id % 30) + 1 - 5) / 25e0 * (case when (drive_id % 30) + 1 > 5 then 1 else 0 end))
 + 0.2e0 * greatest(0, 1 - least(d, 360 - d) / 45e0) as placement from s join m using (drive_id, name_sign) join z using (drive_id, name_sign)),
t as (select *, 0.5e0 * share + 0.5e0 * placement as total from p)
select drive_id, name_sign, round(share, 6) as share, round(track, 6) as stability, round(placement, 6) as placement, round(total, 6) as total,
case when total >= 0.75 then 'high' when total >= 0.5 then 'medium' when total >= 0.3 then 'low' else 'very low' end as label from t""")
def track_stability_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    ends = det.groupBy(*KEYS).agg(F.min_by("course", "frame").alias("a"), F.max_by("course", "frame").alias("b"))
    t = tracks.mode_vote(det, KEYS, "number_sign", "frame").join(tracks.observations(det, KEYS), KEYS).join(tracks.stability(det, KEYS), KEYS).join(ends, KEYS)
    share, placement, total = tracks.confidence(F.col("best_count"), F.col("observations"), F.col("stability"), F.col("drive_id") % 30 + 1.0, tracks.track_azimuth_apart(F.col("a"), F.col("b")))
    return t.select(*KEYS, F.round(share, 6).alias("share"), F.round("stability", 6).alias("stability"), F.round(placement, 6).alias("placement"), F.round(total, 6).alias("total"), tracks.confidence_label(total).alias("label"))


@query(f"""with {DET_SQL} select drive_id, name_sign, case when count(*) = 1 then arg_min((1920 - w <= 640) = (1920 - x <= 640), frame) else arg_min(x, frame) > arg_max(x, frame) end as is_left from det group by 1, 2""")
def track_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.side_from_motion(detections(spark, sf_dir), KEYS, "frame")


@query(f"""with {DET_SQL}, l as (select drive_id, name_sign, det_id, frame, x, y, cast(floor(x / 4e1) as bigint) as e, lag(cast(floor(x / 4e1) as bigint)) over w as pe, lag(x) over w as px, lag(y) over w as py from det window w as (partition by drive_id, name_sign order by frame))
select drive_id, name_sign, det_id, e, coalesce(round_even(sqrt((x - px) ** 2 + (y - py) ** 2), 1), 0) as moved from l where pe is null or pe <> e""")
def collapse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir).withColumn("e", F.floor(F.col("x") / 40.0).cast("long"))
    return tracks.collapse_positions(tracks.displacement(det, KEYS, "frame"), KEYS, "frame", "e").select(*KEYS, "det_id", "e", "moved")


@query(f"""with {DET_SQL}, n as (select *, row_number() over (partition by drive_id, name_sign order by frame) - 1 as i, count(*) over (partition by drive_id, name_sign) as n from det)
select drive_id, name_sign, x as mid_x, y as mid_y, w as mid_w, h as mid_h from n where i = n // 2""")
def median_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.median_box(detections(spark, sf_dir), KEYS, "frame")


@query(f"""with {DET_SQL} select drive_id, name_sign, array_to_string(list(x order by frame), ',') as xs, count(*) as n from det group by 1, 2""")
def track_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tracks.accumulate(detections(spark, sf_dir), KEYS, "frame")
    return a.select(*KEYS, F.array_join(F.col("xs").cast("array<string>"), ",").alias("xs"), F.size("xs").cast("long").alias("n"))


@query(f"""with {DET_SQL} select det_id, drive_id, x, k % 2 = 0 as is_left, row_number() over (partition by x, k % 2 = 0 order by drive_id, frame) + 1 as slot from det""")
def position_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir).withColumn("is_left", F.col("is_side"))
    return features.slots(det, ["drive_id", "frame"], "x").select("det_id", "drive_id", "x", "is_left", F.col("slot").cast("long").alias("slot"))


_UTM_SQL = """g as (select *, 0.00167922038638370e0 as n, radians(lat) as phi, radians(lon) - radians(27e0) as lam from {src}),
h as (select *, 2 * sqrt(n) / (1 + n) as ec, 6378137e0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) as rect from g),
i as (select *, sinh(atanh(sin(phi)) - ec * atanh(ec * sin(phi))) as t from h), j as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from i),
u as (select *, 5e5 + 0.9996e0 * rect * (eta + (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16) * cos(2 * xi) * sinh(2 * eta) + (13 * n ** 2 / 48 - 3 * n ** 3 / 5) * cos(4 * xi) * sinh(4 * eta) + 61 * n ** 3 / 240 * cos(6 * xi) * sinh(6 * eta)) as e,
 0.9996e0 * rect * (xi + (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16) * sin(2 * xi) * cosh(2 * eta) + (13 * n ** 2 / 48 - 3 * n ** 3 / 5) * sin(4 * xi) * cosh(4 * eta) + 61 * n ** 3 / 240 * sin(6 * xi) * cosh(6 * eta)) as nn from j)"""


@query(f"with {DET_SQL}, {_UTM_SQL.format(src='det')} select det_id, round(e, 4) as e, round(nn, 4) as n from u")
def utm_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("det_id", F.round("car_e", 4).alias("e"), F.round("car_n", 4).alias("n"))


@query(f"""with {DET_SQL}, a as (select det_id, radians(lat) as p, radians(lon) as l, radians(course) as z, 5e0 / 6371e3 as d, lat, lon, course from det),
b as (select *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(z)) as q from a), c as (select *, degrees(q) as lat2, degrees(l + atan2(sin(z) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))) as lon2 from b),
e as (select *, radians(lat2) as q2, radians(lon2 - lon) as dl from c)
select det_id, round(lat2, 6) as lat2, round(lon2, 6) as lon2, round(2 * 6371e3 * asin(sqrt(sin((q2 - p) / 2) ** 2 + cos(p) * cos(q2) * sin(dl / 2) ** 2)), 4) as metres,
case when course - 90 > 180 then course - 90 - 360 else course - 90 end as change from e""")
def sphere_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    lat2, lon2 = geo.destination(F.col("lat"), F.col("lon"), F.col("course"))
    d = det.withColumns({"lat2": lat2, "lon2": lon2})
    return d.select("det_id", F.round("lat2", 6).alias("lat2"), F.round("lon2", 6).alias("lon2"), F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("metres"), geo.azimuth_change(F.lit(90.0), F.col("course")).alias("change"))


def _utm_sql(made: str, src: str, lat: str, lon: str, e: str, n: str) -> str:
    """CTEs that give src with the projection (e, n) of its lat and lon."""
    east = " + ".join(f"({a}) * cos({2 * j} * t_xi) * sinh({2 * j} * t_eta)" for j, a in enumerate(geo._ALPHA, 1))
    north = " + ".join(f"({a}) * sin({2 * j} * t_xi) * cosh({2 * j} * t_eta)" for j, a in enumerate(geo._ALPHA, 1))
    return f"""{made}1 as (select *, radians({lat}) as t_phi, radians({lon}) - radians(27e0) as t_lam from {src}), {made}2 as (select *, sinh(atanh(sin(t_phi)) - {geo._ECC} * atanh({geo._ECC} * sin(t_phi))) as t_t from {made}1),
{made}3 as (select *, atan2(t_t, cos(t_lam)) as t_xi, atanh(sin(t_lam) / sqrt(1 + t_t * t_t)) as t_eta from {made}2), {made} as (select * exclude (t_phi, t_lam, t_t, t_xi, t_eta), 5e5 + {geo._K0 * geo._RECT!r} * (t_eta + {east}) as {e}, {geo._K0 * geo._RECT!r} * (t_xi + {north}) as {n} from {made}3)"""


def _from_utm_sql(made: str, src: str, e: str, n: str, lat: str, lon: str) -> str:
    """CTEs that give src with lat and lon of its projected point."""
    scale = repr(geo._K0 * geo._RECT)
    x = " - ".join(["t_xi", *[f"({b}) * sin({2 * j} * t_xi) * cosh({2 * j} * t_eta)" for j, b in enumerate(geo._BETA, 1)]])
    y = " - ".join(["t_eta", *[f"({b}) * cos({2 * j} * t_xi) * sinh({2 * j} * t_eta)" for j, b in enumerate(geo._BETA, 1)]])
    phi = " + ".join(["t_chi", *[f"({d}) * sin({2 * j} * t_chi)" for j, d in enumerate(geo._DELTA, 1)]])
    return f"""{made}1 as (select *, {n} / {scale} as t_xi, ({e} - 5e5) / {scale} as t_eta from {src}), {made}2 as (select *, {x} as t_x, {y} as t_y from {made}1), {made}3 as (select *, asin(sin(t_x) / cosh(t_y)) as t_chi from {made}2),
{made} as (select * exclude (t_xi, t_eta, t_x, t_y, t_chi), degrees({phi}) as {lat}, degrees(radians(27e0) + atan2(sinh(t_y), cos(t_x))) as {lon} from {made}3)"""


_LINES_SQL = f"""s as (select *, k % 3 = 0 as is_left, row_number() over (partition by x, k % 3 = 0 order by drive_id, frame) + 1 as slot from det), {_utm_sql('ua', 's', 'lat', 'lon', 'ce', 'cn')}, {_from_utm_sql('ub', 'ua', 'ce', 'cn', 'la', 'lo')},
d as (select *, radians(la) as phi, radians((course + 180) % 360) as az, 5e0 / 6371000e0 as far from ub), d2 as (select *, asin(sin(phi) * cos(far) + cos(phi) * sin(far) * cos(az)) as back from d),
d3 as (select *, degrees(back) as bla, degrees(radians(lo) + atan2(sin(az) * sin(far) * cos(phi), cos(far) - sin(phi) * sin(back))) as blo from d2), {_utm_sql('uc', 'd3', 'bla', 'blo', 'be', 'bn')},
v as (select *, ce - be as dx, cn - bn as dy, (case when is_left then slot - 1 else slot end) + 0e0 as m, case when is_left then -1e0 else 1e0 end as turn from uc), v2 as (select *, case when is_left then m - 1 else m + 1 end as m2 from v),
v3 as (select *, ce + turn * dy * m as e1, cn - turn * dx * m as n1, case when is_side then be + turn * dy * m else ce + turn * dy * m2 end as e2, case when is_side then bn - turn * dx * m else cn - turn * dx * m2 end as n2 from v2), {_from_utm_sql('ud', 'v3', 'e1', 'n1', 'lat1', 'lon1')}, {_from_utm_sql('ue', 'ud', 'e2', 'n2', 'lat2', 'lon2')}"""


@query(f"""with {DET_SQL}, {_LINES_SQL} select det_id, cast(slot as int) as slot, round(case when is_side then (((course + case when is_left then -90 else 90 end) % 360) + 360) % 360 else course end, 6) as azimuth, round(lat1, 6) as lat1, round(lon1, 6) as lon1, round(lat2, 6) as lat2, round(lon2, 6) as lon2 from ue""")
def sign_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = placed(spark, sf_dir).withColumnRenamed("course", "azimuth").withColumn("is_left", F.col("k") % 3 == 0)
    made = features.lines(features.slots(t, ["drive_id", "frame"], "x"))
    return made.select("det_id", "slot", *[F.round(c, 6).alias(c) for c in ("azimuth", "lat1", "lon1", "lat2", "lon2")])


@query(f"""with {DET_SQL}, {ROADS_SQL}, pts as (select s_suppkey * 10 as point_id, 5.38e1 + ((s_suppkey*7919) % 2000)/1e4 + ((s_suppkey % 9) - 4) / 2e4 as lat, 2.74e1 + ((s_suppkey*104729) % 3000)/1e4 + ((s_suppkey % 11) - 5) / 2e4 as lon from supplier),
m as (select point_id, lat, lon, way_id, lat1, lon1, lat2, lon2, cos(radians(lat)) * 111320e0 as kx from pts cross join roads),
v as (select *, (lon2 - lon1) * kx as dx, (lat2 - lat1) * 111320e0 as dy, (lon - lon1) * kx as px, (lat - lat1) * 111320e0 as py from m),
t as (select *, case when dx * dx + dy * dy > 0 then greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) else 0 end as t from v),
s as (select *, lat1 + t * (lat2 - lat1) as slat, lon1 + t * (lon2 - lon1) as slon from t),
d as (select point_id, way_id, 2 * 6371e3 * asin(sqrt(least(1, sin((radians(slat) - radians(lat)) / 2) ** 2 + cos(radians(lat)) * cos(radians(slat)) * sin(radians(slon - lon) / 2) ** 2))) as m from s),
k as (select *, row_number() over (partition by point_id order by m, way_id) as k from d where m <= 250)
select p.point_id, way_id is not null as snapped, way_id, round(m, 4) as metres from pts p left join (select * from k where k = 1) b on p.point_id = b.point_id""")
def segment_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points near road starts, snapped within 250 m by a cell join."""
    k = F.col("s_suppkey")
    pts = table(spark, sf_dir, "supplier").select((k * 10).alias("point_id"), (53.8 + (k * 7919 % 2000) / 1e4 + (k % 9 - 4) / 2e4).alias("lat"), (27.4 + (k * 104729 % 3000) / 1e4 + (k % 11 - 5) / 2e4).alias("lon"))
    out = snap.snap(pts, snap.segments(road_ways(spark, sf_dir)), radius_m=250.0)
    return out.select("point_id", "snapped", F.col("road_way_id").alias("way_id"), F.round("road_distance", 4).alias("metres"))


@query("""with a as (select s_suppkey as id, (s_suppkey * 7919) % 3000 + 0e0 as e, (s_suppkey * 104729) % 3000 + 0e0 as n from supplier), b as (select c_custkey as id, (c_custkey * 6007) % 3000 + 0e0 as e, (c_custkey * 5003) % 3000 + 0e0 as n from customer)
select a.id as a_id, b.id as b_id, round(sqrt((a.e - b.e) ** 2 + (a.n - b.n) ** 2), 6) as distance from a join b on sqrt((a.e - b.e) ** 2 + (a.n - b.n) ** 2) <= 20""")
def grid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    a = table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 7919 % 3000 + F.lit(0.0)).alias("e"), (s * 104729 % 3000 + F.lit(0.0)).alias("n"))
    b = table(spark, sf_dir, "customer").select(c.alias("id"), (c * 6007 % 3000 + F.lit(0.0)).alias("e"), (c * 5003 % 3000 + F.lit(0.0)).alias("n"))
    return dedup.near_pairs(a, b).withColumn("distance", F.round("distance", 6))


@query()
def grid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("det_id")
    f = detections(spark, sf_dir).select(i.alias("seq"), F.col("name_sign").alias("type"), F.col("is_side").alias("is_left"), (i * 7919 % 2000 + F.lit(0.0)).alias("e"), (i * 104729 % 2000 + F.lit(0.0)).alias("n"), F.col("course").alias("azimuth"), F.col("k").alias("length"))
    return dedup.grid_dedup(f)


@query(f"""with {DET_SQL}, t as (select drive_id, scene_id + 1 as scene, det_id as track_id, name_sign as track_class, x as track_x, y as track_y from det), d as (select drive_id, scene_id as scene, det_id, name_sign as det_class, x as det_x, y as det_y from det),
p as (select t.drive_id, t.scene as frame, track_id, det_id, track_class = det_class as match, round_even(sqrt((det_x - track_x) ** 2 + (det_y - track_y) ** 2), 1) + case when track_class = det_class then -50 else 50 end as distance from t join d on t.drive_id = d.drive_id and t.scene = d.scene where det_y - track_y <= 10),
a as (select *, row_number() over (partition by drive_id, frame, track_id order by distance, det_id) as k from p where distance <= 800),
b as (select *, row_number() over (partition by drive_id, frame, det_id order by match desc, distance, track_id) as m from a where k = 1)
select drive_id, frame, track_id, det_id, distance, match from b where m = 1""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of neighbouring scenes of a drive as tracks and detections."""
    d = detections(spark, sf_dir)
    t = d.select("drive_id", (F.col("scene_id") + 1).alias("frame"), F.col("det_id").alias("track_id"), F.col("name_sign").alias("track_class"), F.col("x").alias("track_x"), F.col("y").alias("track_y"))
    n = d.select("drive_id", F.col("scene_id").alias("frame"), "det_id", F.col("name_sign").alias("det_class"), F.col("x").alias("det_x"), F.col("y").alias("det_y"))
    return clean.nearest_match(t.join(n, ["drive_id", "frame"]))


@query("select p_partkey as id, n_name as type, cast(n_nationkey as bigint) as code from part join nation on p_partkey % 40 = n_nationkey")
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of known types with their codes; nations stand for the catalogue."""
    codes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("type"), F.col("n_nationkey").alias("code"), "n_name")
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).cast("string").alias("number_sign"))
    named = features.with_code(f, codes).join(F.broadcast(codes.select(F.col("type").alias("number_sign"), "n_name")), "number_sign")
    return named.select("id", F.col("n_name").alias("type"), "code")


@query("select p_partkey as id, coalesce(n_name, '') as name from part left join nation on p_partkey % 40 = n_nationkey")
def catalog_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return features.with_name(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("k")), n, "k").drop("k")


@query("select p_partkey as id, unnest(list_distinct(string_split(p_type, ' '))) as type from part")
def lane_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("5.8").alias("name_sign"), F.replace("p_type", F.lit(" "), F.lit("-")).alias("number_sign"), F.lit(True).alias("is_left"))
    return features.expand_lanes(t).select("id", F.col("number_sign").alias("type"))


@query("""select o_orderkey as id, o_orderkey * 977 // 63600 as video, o_orderkey * 977 % 63600 as frame, printf('%d:%02d', o_orderkey * 977 % 63600 // 3600, o_orderkey * 977 % 63600 // 60 % 60) as time,
cast(floor(o_orderkey / 6e1 + 0.5) as bigint) as second from orders""")
def frame_to_video_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 977).alias("abs"))
    v = scalars.video_frame(F.col("abs"))
    return f.withColumn("v", v).select("id", "v.video", "v.frame", scalars.time_text(F.col("v.frame")).alias("time"), scalars.frame_second(F.col("id")).alias("second"))


_RECS = "r as (select c_custkey as id, c_custkey as seq, c_mktsegment as type, c_name as name, (c_custkey * 37 % 101) / 1e2 as confidence, c_custkey % 7 = 0 as deleted from customer)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), k.alias("seq"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name"), (k * 37 % 101 / 1e2).alias("confidence"), (k % 7 == 0).alias("deleted"))


@query(f"with {_RECS} select id, type, name, confidence from r where (contains(lower(type), 'build') or contains(lower(name), 'build')) and confidence < 0.5")
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.listing(_records(spark, sf_dir), "BUILD", low_only=True).select("id", "type", "name", "confidence")


@query(f"with {_RECS} select count(*) filter (where not deleted) as total, count(*) filter (where not deleted and confidence < 0.5) as low from r")
def review_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counters(_records(spark, sf_dir))


@query("select c_custkey as id, coalesce(lag(c_custkey) over w, c_custkey) as prev_id, coalesce(lead(c_custkey) over w, c_custkey) as next_id from customer window w as (order by c_custkey)")
def review_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.neighbours(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), ["id"])


_FEATS = "f as (select c_custkey as id, c_mktsegment as type, cast(c_nationkey as bigint) as code, c_name as t from customer), e as (select o_custkey as id, min(o_orderkey) as k from orders group by 1)"


@query(f"""with {_FEATS} select f.id, case when e.id is null then type when k % 3 = 0 then '3.24' else '2.1' end as type, case when e.id is null then code when k % 3 = 0 then 10320 else 10211 end as code,
case when e.id is null then t when k % 3 = 0 then cast(k as varchar) end as SEM250, case when e.id is null then t when k % 3 = 0 then cast(k as varchar) end as MVALUE from f left join e on f.id = e.id where e.id is null or k % 5 <> 0""")
def edit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.catalog import sign_codes

    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_nationkey").cast("long").alias("code"), F.col("c_name").alias("SEM250"), F.col("c_name").alias("MVALUE"))
    k = F.col("k")
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("k")).select("id", F.when(k % 3 == 0, "3.24").otherwise("2.1").alias("new_type"), k.cast("string").alias("new_text"), (k % 5 == 0).alias("deleted"))
    return review.apply_edits(f, e, sign_codes(spark))


@query("select c_custkey as id, c_name as name from customer where c_custkey not in (select o_custkey from orders)")
def feature_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom import api

    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return api.delete(f, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query(f"with {DET_SQL} select cast(det_id as varchar) as id, name_sign as type, coalesce(cast(k as bigint), 0) as code, '' as description, lat, lon from det where frame % 2 = 0")
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom import api

    d = detections(spark, sf_dir)
    line = F.when(F.col("frame") % 2 == 0, F.array(F.array("lon", "lat"), F.array("lon", "lat"))).otherwise(F.array().cast("array<array<double>>"))
    f = d.select(F.struct(line.alias("coordinates")).alias("geometry"), F.struct(F.col("det_id").cast("string").alias("id"), F.col("name_sign").alias("type"), F.col("k").cast("long").alias("code")).alias("properties"))
    return api.signs(f).select("id", "type", "code", "description", "lat", "lon")


@query(r"select doc_id, len(regexp_extract_all(text, '-?[0-9]+')) as n, coalesce(list_sum(list_transform(regexp_extract_all(text, '-?[0-9]+'), lambda x: length(x))), 0) as digits from documents")
def parse_int_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"-?\d+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(scalars.ints_in(F.col("text")))).cast("long").alias("n"), F.coalesce(F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + F.length(x)), F.lit(0).cast("long")).alias("digits"))


@query()
def fuzzy_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt nation names against the list of nations."""
    n = table(spark, sf_dir, "nation")
    return fuzzy.fuzzy_match(n.select(F.col("n_nationkey").alias("id"), F.concat(F.expr("left(n_name, 3)"), F.expr("substr(n_name, 5)"), F.lit("a1")).alias("text")), n.select(F.col("n_name").alias("name")))


@query(f"with {DET_SQL} select det_id, 'straight' as part from det where k < 60 union all select det_id, 'turn' from det where k >= 30 and det_id not in (select det_id from det where k >= 80)")
def union_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    turn = d.where("k >= 30").join(d.where("k >= 80").select("det_id"), "det_id", "left_anti")
    return features.union_layers(d.where("k < 60").select("det_id"), turn.select("det_id"))


@query(f"""with {DET_SQL}, a as (select drive_id, frame, course - lag(course) over (partition by drive_id order by frame) as d from det), b as (select drive_id, frame, coalesce(case when d > 180 then d - 360 when d <= -180 then d + 360 else d end, 0) as c from a),
o as (select *, abs(c) > 45 as on_turn, coalesce(abs(lag(c) over (partition by drive_id order by frame)) > 45, false) as before from b),
g as (select *, sum(case when on_turn and not before then 1 else 0 end) over (partition by drive_id order by frame) as turn_id from o)
select drive_id, turn_id, min(frame) as first_frame, max(frame) as last_frame, round(sum(c), 6) as change, count(*) as points from g where on_turn group by 1, 2""")
def turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turn_islands(detections(spark, sf_dir), 45.0).withColumn("change", F.round("change", 6))


@query(f"with {DET_SQL} select drive_id, count(*) as frames, sum(case when speed >= 2 then 1 else 0 end) as moving, cast(floor(max(frame) * 100 / 63600e0) as int) as progress from det group by 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.throughput(detections(spark, sf_dir).withColumnRenamed("frame", "frame_number"), ["drive_id"])


@query(f"with {DET_SQL} select det_id, x, y, w, h, k % 2 = 0 as is_side from det")
def clean_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners to boxes."""
    d = detections(spark, sf_dir)
    raw = d.select("det_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), (F.col("k") % 2).alias("side_class"))
    return clean.boxes(raw)


@query(f"""with {DET_SQL}, p as (select det_id, drive_id, name_sign, (k % 100) / 1e2 as a, 1 - (k % 100) / 1e2 as b, case when k % 5 = 0 then null when k % 7 = 0 then '-1' else '4.1.' || (k % 3) end as lane from det)
select det_id, drive_id, case name_sign when 'click' then case when a >= b then '1.1' else '1.2' end when 'view' then lane else name_sign end as number_sign from p
where case name_sign when 'click' then greatest(a, b) >= 0.6 when 'view' then lane is not null and lane <> '-1' else true end""")
def fine_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine classes by model, lane string or coarse class; unsure ones go."""
    d, k = detections(spark, sf_dir), F.col("k")
    a = (k % 100) / 1e2
    kind = F.when(F.col("name_sign") == "view", "5.8").otherwise(F.col("name_sign"))
    raw = d.select("det_id", "drive_id", kind.alias("name_sign"), F.array(a, 1 - a).alias("fine_probabilities"), F.when(k % 5 == 0, None).when(k % 7 == 0, "-1").otherwise(F.concat(F.lit("4.1."), (k % 3).cast("string"))).alias("lane_type"))
    return clean.fine_class(raw, ["click"], {"click": ["1.1", "1.2"]}).select("det_id", "drive_id", "number_sign")


@query(f"with {DET_SQL} select det_id, case when k % 2 = 0 then 'line' when k % 3 = 0 then 'city' end as text_route from det")
def text_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = detections(spark, sf_dir), F.col("k")
    raw = d.select("det_id", F.when(k % 2 == 0, "3.24").otherwise("1.1").alias("number_sign"), F.when(k % 3 == 0, "konec nas punkta sin").otherwise("red").alias("name_sign"))
    return clean.text_route(raw).select("det_id", "text_route")


@query(f"""with {DET_SQL}, s as (select drive_id, concat(name_sign, '') as name, sum(k) as s, min(det_id) as f from det group by 1, 2), r as (select *, row_number() over (partition by drive_id order by s desc, f) as i from s) select drive_id, name as city from r where i = 1""")
def city_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name with the largest sum of accuracies; the number k stands for one."""
    return tracks.city_score(detections(spark, sf_dir).select("drive_id", F.col("det_id").alias("seq"), F.col("name_sign").alias("name"), F.col("k").alias("accuracy")), ["drive_id"])


@query(f"""with {DET_SQL} select det_id, case when k % 10 in (3, 4) then 'rev_end' when k % 10 in (5, 6) then 'rev_start' when k % 10 in (7, 8) then 'rev_end' else 'start' end as anchor from det""")
def turn_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions 0 to 9 of a turn and their anchors; 9 isn't listed and takes the start."""
    d = detections(spark, sf_dir).select("det_id", (F.col("k") % 10).cast("string").alias("number"))
    return turns.anchor_of(d).select("det_id", "anchor")


@query(f"""with {DET_SQL} select det_id, row_number() over (partition by drive_id, scene_id % 3, k % 10 order by det_id) + 1 as slot from det where name_sign <> 'view'""")
def turn_pole_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots at a turn's positions; one event type stands for lane signs."""
    d = detections(spark, sf_dir).withColumns({"turn_id": F.col("scene_id") % 3, "number": F.col("k") % 10, "name_sign": F.when(F.col("name_sign") == "view", "5.8").otherwise(F.col("name_sign"))})
    return features.turn_slots(d, ["det_id"]).select("det_id", F.col("slot").cast("long").alias("slot"))


@query(f"with {DET_SQL}, {_UTM_SQL.format(src='det')} select drive_id, count(*) as points from u group by 1")
def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.sources import gpx

    return gpx.point_count(placed(spark, sf_dir))


@query(r"select doc_id, lower(regexp_replace(text, '[^a-zA-Zа-яА-ЯёЁ]', '', 'g')) as letters from documents")
def text_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.letters(F.col("text")).alias("letters"))


@query(r"select doc_id, len(regexp_extract_all(text, '-?[0-9]+\.?[0-9]*')) as n, round(coalesce(list_sum(list_transform(regexp_extract_all(text, '-?[0-9]+\.?[0-9]*'), lambda x: length(x))), 0), 6) as digits from documents")
def parse_float_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"-?[0-9]+\.?[0-9]*"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(scalars.floats_in(F.col("text")))).cast("long").alias("n"), F.round(F.coalesce(F.aggregate(found, F.lit(0.0), lambda s, x: s + F.length(x)), F.lit(0.0)), 6).alias("digits"))


@query(f"""with {DET_SQL} select det_id, least(1e0, case when k = 0 then 0e0 else k / greatest(k % 7, 1) end) * (case when k % 7 = 0 then 0 else 1 end) as confidence, k % 7 as n from det""")
def review_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of features with k % 7 frames and length k."""
    d, n = detections(spark, sf_dir), F.col("k") % 7
    frames = F.when(n > 0, scalars.list_text(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).otherwise("[]")
    flat = d.select(F.col("det_id").alias("id"), F.lit("1.1").alias("type"), F.col("k").cast("string").alias("length"), scalars.bool_text(F.col("is_side")).alias("left"), *[frames.alias(c) for c in ("frame_numbers", "absolute_frame_numbers", "pixel_coordinates_x", "pixel_coordinates_y", "w", "h")], n.alias("n"))
    return review.records(flat).select(F.col("id").alias("det_id"), "confidence", "n")



@query(f"""with {DET_SQL}, f as (select drive_id, det_id, (k % 12) - 2 as gps_index from det), g as (select drive_id, frame - 1 as idx, lat, lon from det)
select f.drive_id, det_id, gps_index, coalesce(lat, 0) as prev_lat, coalesce(lon, 0) as prev_lon from f left join g on f.drive_id = g.drive_id and g.idx = greatest(0, gps_index)""")
def gps_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point that a frame comes from; indices from -2 to 9, so some lie before the first and past the last."""
    d = detections(spark, sf_dir)
    gps = d.select("drive_id", (F.col("frame") - 1).alias("idx"), "lat", "lon")
    return align.previous(d.select("drive_id", "det_id", (F.col("k") % 12 - 2).alias("gps_index")), gps)


@query(f"""with {ROADS_SQL}, r as (select way_id, radians(lat1) as p, radians(lat2) as q, radians(lon2 - lon1) as d from roads where lat1 <> lat2 or lon1 <> lon2),
b as (select *, degrees(atan2(sin(d) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(d))) + 360 as z from r)
select way_id, round(z - 360 * floor(z / 360), 6) as azimuth, round(2 * 6371e3 * asin(sqrt(least(1, sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(d / 2) ** 2))), 4) as metres from b""")
def road_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and length of road segments; a segment without length has no direction."""
    s = snap.segments(road_ways(spark, sf_dir)).where("lat1 <> lat2 or lon1 <> lon2")
    at = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    return s.select(F.col("way_id"), F.round(geo.bearing(*at), 6).alias("azimuth"), F.round(geo.haversine(*at), 4).alias("metres"))


@query(f"""with {DET_SQL}, a as (select det_id, radians(lat) as p, radians(lon) as l, radians(course) as z, (5 + k % 20) / 6371e3 as d from det), t as (select *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(z)) as q from a)
select det_id, round(degrees(q), 9) as lat, round(degrees(l + atan2(sin(z) * sin(d) * cos(p), cos(d) - sin(p) * sin(q))), 9) as lon from t""")
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of lines of 5 to 24 m along the course."""
    d = detections(spark, sf_dir)
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.col("course"), 5 + F.col("k") % 20)
    return d.select("det_id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("""select o_orderkey as id, o_orderkey % 3 = 0 as is_left, o_orderkey % 4 = 0 as any_left, split_part(o_orderpriority, '-', 1) as icon, coalesce(nullif(split_part(o_orderpriority, '-', 2), ''), '') as icon_text,
case when o_orderkey % 5 = 0 then 0 else cast(o_orderkey as int) end as length, case when length(t) > 32 then substr(t, 1, 30) || '…' else t end as name
from (select *, repeat(o_orderpriority || ' ', 1 + cast(o_orderkey % 5 as int)) as t from orders)""")
def property_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, icons, lengths and shown names as stored features write them; a length that isn't a number is 0."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumns({"flag": scalars.bool_text(k % 3 == 0), "flags": scalars.list_text(F.array(scalars.bool_text(k % 4 == 0), F.lit("False"))), "icon_id": scalars.image_id(F.col("o_orderpriority")), "long": F.repeat(F.concat("o_orderpriority", F.lit(" ")), (1 + k % 5).cast("int"))})
    length = scalars.length_or_zero(F.when(k % 5 == 0, "none").otherwise(k.cast("string")))
    return o.select(k.alias("id"), scalars.is_true(F.col("flag")).alias("is_left"), scalars.says_true(F.col("flags")).alias("any_left"), F.col("icon_id.type").alias("icon"), F.col("icon_id.text").alias("icon_text"), length.alias("length"), scalars.short_name(F.col("long")).alias("name"))


@query("select cast(coalesce(sum(case when o_orderkey % 6 <> 0 then o_orderkey % 63600 end), 0) as bigint) as frames from orders")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all videos; every sixth can't be opened."""
    from roadloom.sources import roads

    k = F.col("o_orderkey")
    return roads.frame_count(table(spark, sf_dir, "orders").select(k.alias("video"), F.when(k % 6 != 0, k % 63_600).alias("frame_count")))


@query(f"with {DET_SQL} select det_id, drive_id, cast(x as int) as x, cast(y as int) as y, cast(w as int) as w, cast(h as int) as h, name_sign, number_sign, frame as frame_number, frame * 40 as absolute_frame_number, lon as car_e, lat as car_n, case when k % 4 = 0 then '' else cast(k as varchar) end as text_on_sign, k % 3 = 1 as is_side from det")
def detection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored detections; every fourth has no text, every third no side."""
    k = F.col("k")
    raw = detections(spark, sf_dir).withColumns({"box": F.struct("x", "y", "w", "h"), "frame_number": F.col("frame"), "absolute_frame_number": F.col("frame") * 40, "car_e": F.col("lon"), "car_n": F.col("lat"), "text": F.when(k % 4 != 0, k.cast("string")), "is_side": F.when(k % 3 != 0, k % 3 == 1)})
    return clean.detected(raw)


@query(f"""with {DET_SQL}, t as (select det_id, (det_id * 977) % 400000 as mean_frame from det), v as (select s_suppkey - 1 as video, s_name as name_video from supplier where s_suppkey <= 5)
select det_id, coalesce(name_video, 'unknown') as name_video, printf('%d:%02d', mean_frame % 63600 // 3600, mean_frame % 63600 // 60 % 60) as time from t left join v on v.video = mean_frame // 63600""")
def video_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos and times of mean frames; five videos are listed, frames beyond them are of an unknown one."""
    t = detections(spark, sf_dir).select("det_id", (F.col("det_id") * 977 % 400_000).cast("double").alias("mean_frame"))
    v = table(spark, sf_dir, "supplier").where("s_suppkey <= 5").select((F.col("s_suppkey") - 1).alias("video"), F.col("s_name").alias("name_video"))
    return features.video_columns(t, v).select("det_id", "name_video", "time")


@query(f"with {DET_SQL} select det_id, case when k % 3 = 0 then null when k % 9 >= 5 then 1 when k % 9 >= 2 then 2 else 0 end as best from det")
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the largest probability, the first of equals; every third has none."""
    r = F.col("k") % 9
    p = F.when(F.col("k") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.when(r < 2, 0.9).otherwise(0.1), F.when(r >= 5, 0.8).otherwise(0.2), F.when(r >= 2, 0.8).otherwise(0.3)))
    return detections(spark, sf_dir).select("det_id", scalars.top_class(p).alias("best"))


@query(f"""with {DET_SQL}, a as (select drive_id, scene_id, det_id, case k % 4 when 0 then 'L' when 1 then 'R' when 2 then 'B' end as c, k % 5 >= 2 as covered, k % 7 < 4 as gap from det)
select drive_id, scene_id, coalesce(string_agg(case c when 'L' then '{LANE_DIRECTIONS["left"]}' when 'R' then '{LANE_DIRECTIONS["right"]}' when 'B' then '{LANE_DIRECTIONS["back"]}' end, '-' order by det_id) filter (where covered and (c <> 'B' or gap)), '') as lane_type from a group by 1, 2""")
def lane_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a scene as the arrows of a sign: 2 x 2 masks of 0 to 4 cells, centre rows with and without a gap."""
    from roadloom.operators import lanes

    k = F.col("k")
    cell = lambda i: F.when(k % 5 > i, 1.0).otherwise(0.0)
    direction = F.element_at(F.array(*map(F.lit, ("left", "right", "back", "none"))), (k % 4 + 1).cast("int"))
    a = detections(spark, sf_dir).select("drive_id", "scene_id", F.col("det_id").alias("seq"), direction.alias("direction"), F.array(F.array(cell(0), cell(1)), F.array(cell(2), cell(3))).alias("mask"), F.lit(2).alias("w"), F.lit(2).alias("h"), F.array(F.lit(1), F.when(k % 7 < 4, 0).otherwise(1), F.lit(1)).alias("centre_row"))
    return lanes.lane_types(a, ["drive_id", "scene_id"])


TURNING = replace(DEFAULT, turn_change=45.0)


@query(f"""with {DET_SQL}, a as (select drive_id, frame, course, course - lag(course) over (partition by drive_id order by frame) as d from det), o as (select *, coalesce(abs(case when d > 180 then d - 360 when d < -180 then d + 360 else d end) > 45, false) as on_turn from a),
b as (select *, on_turn and not coalesce(lag(on_turn) over (partition by drive_id order by frame), false) as opens from o), g as (select *, sum(case when opens then 1 else 0 end) over (partition by drive_id order by frame) as turn_id from b),
t as (select drive_id, turn_id, min(frame) as first_frame, max(frame) as last_frame, count(*) as points, arg_min(course, frame) as a0, arg_max(course, frame) as a1, array_to_string(list(cast(course as int) order by frame), ',') as azimuths from g where on_turn group by 1, 2 having count(*) > 1)
select drive_id, turn_id, first_frame, last_frame, points, azimuths, case when (case when a1 - a0 > 180 then a1 - a0 - 360 when a1 - a0 < -180 then a1 - a0 + 360 else a1 - a0 end) >= 0 then 'right' else 'left' end as direction from t""")
def tracker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that the tracker gives beside its tracks."""
    t = tracker.tracks_and_turns(_tracker_input(spark, sf_dir), TURNING).where("kind = 'turn'")
    return t.select("drive_id", "turn_id", "first_frame", "last_frame", F.size("frames").cast("long").alias("points"), F.array_join(F.transform("azimuths", lambda a: a.cast("int").cast("string")), ",").alias("azimuths"), F.col("turn_direction").alias("direction"))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey <= 5").select((F.col("s_suppkey") - 1).alias("video"), F.col("s_name").alias("name_video"))


def _event_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event classes as known types: all but those that end in .0."""
    return detections(spark, sf_dir).select(F.col("number_sign").alias("type")).distinct().where(~F.col("type").endswith(".0")).withColumn("code", F.length("type").cast("string"))


@query(f"""with {DET_SQL}, c as (select drive_id, name_sign, number_sign, count(*) as n, min(frame) as f from det group by 1, 2, 3), r as (select *, row_number() over (partition by drive_id, name_sign order by n desc, f) as k from c),
x as (select drive_id, name_sign, case when k % 4 = 0 then null else concat('n', k % 3) end as t, frame from det), y as (select drive_id, name_sign, t, count(*) as n, min(frame) as f, sum(count(*)) over (partition by drive_id, name_sign) as every from x where t is not null group by 1, 2, 3),
z as (select *, row_number() over (partition by drive_id, name_sign order by n desc, f) as k from y),
o as (select drive_id, name_sign, count(*) as n, array_to_string(list(case when is_side then 'True' else 'False' end order by frame), ', ') as sides, array_to_string(list(x order by frame), ', ') as xs, array_to_string(list(y order by frame), ', ') as ys, array_to_string(list(w order by frame), ', ') as ws,
 array_to_string(list(h order by frame), ', ') as hs, array_to_string(list(lon order by frame), ', ') as es, array_to_string(list(lat order by frame), ', ') as ns, array_to_string(list(frame order by frame), ', ') as fs, array_to_string(list(frame * 40 order by frame), ', ') as afs, sum(frame * 40) / count(*) as mean, max(frame * 40) as num, max(course) as azimuth, max(lat) as lat1, max(lon) as lon1 from det group by 1, 2),
v as (select s_suppkey - 1 as video, s_name as name_video from supplier where s_suppkey <= 5)
select o.drive_id, o.name_sign, r.number_sign as type, cast(o.n as varchar) as length, concat('[', sides, ']') as side, case when o.n % 2 = 0 then 'left' else 'straight' end as turn, case when o.n % 3 = 0 then 'True' else 'False' end as "left", cast(num as varchar) as num, concat('[', xs, ']') as pixel_coordinates_x, concat('[', ys, ']') as pixel_coordinates_y,
 concat('[', hs, ']') as h, concat('[', ws, ']') as w, concat('[', es, ']') as car_coordinates_x, concat('[', ns, ']') as car_coordinates_y, concat('[', fs, ']') as frame_numbers, concat('[', afs, ']') as absolute_frame_numbers, cast(azimuth as varchar) as azimuth,
 substr(sha256(concat_ws('|', o.drive_id, o.name_sign, r.number_sign, lat1, lon1)), 1, 32) as id, printf('%d:%02d', cast(floor(mean) as bigint) % 63600 // 3600, cast(floor(mean) as bigint) % 63600 // 60 % 60) as time, coalesce(name_video, 'unknown') as name_video,
 case when r.number_sign = '3.24' then case when z.every > 4 then z.t else '' end end as "MVALUE", case when r.number_sign = '3.24' then case when z.every > 4 then z.t else '' end end as "SEM250", 7 as code
from o join (select drive_id, name_sign, case when number_sign like '%.1' then '3.24' else number_sign end as number_sign from r where k = 1) r using (drive_id, name_sign) left join z on z.drive_id = o.drive_id and z.name_sign = o.name_sign and z.k = 1 left join v on v.video = cast(floor(mean) as bigint) // 63600""")
def stored_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21 properties of stored features, of each drive's detections of a class as a track."""
    k = F.col("k")
    d = detections(spark, sf_dir).withColumns({"car_e": F.col("lon"), "car_n": F.col("lat"), "frame_number": F.col("frame"), "abs_frame": F.col("frame") * 40, "text": F.when(k % 4 != 0, F.concat(F.lit("n"), (k % 3).cast("string")))})
    lists = tracks.accumulate(d, KEYS, "frame").select(*KEYS, "xs", "ys", "ws", "hs", "car_es", "car_ns", F.col("frame_numbers").alias("frames"), "abs_frames", F.col("is_sides").alias("sides"), "texts")
    own = d.groupBy(*KEYS).agg(F.count("*").alias("observations"), F.max("course").alias("azimuth"), F.max("lat").alias("lat1"), F.max("lon").alias("lon1"), F.max("abs_frame").alias("num"))
    t = tracks.mode_vote(d, KEYS, "number_sign", "frame").join(lists, KEYS).join(own, KEYS)
    n = F.col("observations")
    t = t.withColumns({"number_sign": F.when(F.col("best").endswith(".1"), "3.24").otherwise(F.col("best")), "turn_direction": F.when(n % 2 == 0, "left").otherwise("straight"), "is_left": n % 3 == 0, "track_id": F.col("name_sign"), "lat2": F.col("lat1"), "lon2": F.col("lon1"), "code": F.lit(7)})
    return layer.stored(t, _videos(spark, sf_dir)).select(*KEYS, "properties.*")


@query()
def sign_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections to the stored layer, turns included."""
    d = _tracker_input(spark, sf_dir).withColumn("abs_frame", F.col("frame") * 40)
    made = layer.sign_layer(d, snap.segments(road_ways(spark, sf_dir)), _videos(spark, sf_dir), _event_codes(spark, sf_dir), TURNING)
    return made.select("properties.*", F.to_json("geometry").alias("geometry"))


@query("select c_custkey as id, c_name as name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' or o_custkey % 2 = 0)")
def feature_delete_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with urgent orders go, and those with even keys that have any."""
    from roadloom import api

    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    gone = table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_custkey") % 2 == 0))
    return api.delete(f, gone.select(F.col("o_custkey").alias("id")))
