"""Detections, roads and features made from the driver's tables, as inputs of the queries.

The same projections exist as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import to_utm

DET_SQL = r"""det as (
select event_id as det_id, user_id as drive_id,
 row_number() over (partition by user_id order by ts, event_id) as frame,
 cast(floor(event_id/8e0) as bigint) as scene_id, event_type as name_sign,
 concat(event_type, '.', cast(k % 3 as varchar)) as number_sign, k,
 (event_id*37) % 160 as x, (event_id*53) % 90 as y, 30 + k % 40 as w, 30 + (k*7) % 40 as h,
 k % 2 = 0 as is_side, value - 4e1*floor(value/4e1) as speed,
 5.38e1 + ((event_id*7919) % 2000)/1e4 as lat, 2.74e1 + ((event_id*104729) % 3000)/1e4 as lon,
 ((event_id*613) % 360) + 0e0 as course
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e)"""

ROADS_SQL = r"""roads as (
select s_suppkey as way_id, case when s_suppkey % 5 = 0 then 'footway' else 'primary' end as highway, s_name as name,
 5.38e1 + ((s_suppkey*7919) % 2000)/1e4 as lat1, 2.74e1 + ((s_suppkey*104729) % 3000)/1e4 as lon1,
 5.38e1 + ((s_suppkey*7919) % 2000)/1e4 + ((s_nationkey % 7)-3)/1e3 as lat2,
 2.74e1 + ((s_suppkey*104729) % 3000)/1e4 + ((s_nationkey % 5)-1)/1e3 as lon2
from supplier)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection an event: a user's events are the frames of a drive."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    i = F.col("event_id")
    return e.select(
        i.alias("det_id"), F.col("user_id").alias("drive_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("frame"),
        F.floor(i / 8.0).cast("long").alias("scene_id"), F.col("event_type").alias("name_sign"), F.concat("event_type", F.lit("."), (F.col("k") % 3).cast("string")).alias("number_sign"), "k",
        (i * 37 % 160).alias("x"), (i * 53 % 90).alias("y"), (30 + F.col("k") % 40).alias("w"), (30 + F.col("k") * 7 % 40).alias("h"),
        (F.col("k") % 2 == 0).alias("is_side"), (F.col("value") - 40.0 * F.floor(F.col("value") / 40.0)).alias("speed"),
        (53.8 + (i * 7919 % 2000) / 1e4).alias("lat"), (27.4 + (i * 104729 % 3000) / 1e4).alias("lon"), (i * 613 % 360 + F.lit(0.0)).alias("course"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with projected car positions."""
    det = detections(spark, sf_dir)
    e, n = to_utm(F.col("lat"), F.col("lon"))
    return det.withColumns({"car_e": e, "car_n": n})


def road_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    lat, lon = 53.8 + (k * 7919 % 2000) / 1e4, 27.4 + (k * 104729 % 3000) / 1e4
    node = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return s.select(k.alias("way_id"), F.col("s_name").alias("name"), F.when(k % 5 == 0, "footway").otherwise("primary").alias("highway"), F.array(node(lat, lon), node(lat + (F.col("s_nationkey") % 7 - 3) / 1e3, lon + (F.col("s_nationkey") % 5 - 1) / 1e3)).alias("nodes"))
