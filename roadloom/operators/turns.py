"""Turns of a drive. The definition is ours: runs of frames whose course changes by more than a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.catalog import TURN_ANCHORS
from roadloom.functions.geo import azimuth_change, turn_anchors


def turn_islands(gps: DataFrame, least_change: float = 10.0, order: str = "frame") -> DataFrame:
    """turn_id, drive_id, first and last frame and the total change of each run of turning points."""
    w = Window.partitionBy("drive_id").orderBy(order)
    change = azimuth_change(F.lag("course").over(w), F.col("course"))
    marked = gps.withColumn("_change", F.coalesce(change, F.lit(0.0))).withColumn("_on", F.abs("_change") > least_change)
    run = F.sum(F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0)).over(w)
    return marked.withColumn("turn_id", run).where("_on").groupBy("drive_id", "turn_id").agg(F.min(order).alias("first_frame"), F.max(order).alias("last_frame"), F.sum("_change").alias("change"), F.count("*").alias("points"))


def anchors(turns: DataFrame) -> DataFrame:
    """turns (coordinates array<struct<lat,lon>>, azimuths) with their four anchors."""
    a, b = F.element_at("coordinates", 1), F.element_at("coordinates", -1)
    az0, az1 = F.coalesce(F.get("azimuths", F.lit(0)), F.lit(0.0)), F.coalesce(F.try_element_at("azimuths", F.lit(-1)), F.lit(0.0))
    return turns.where(F.size("coordinates") > 0).withColumn("anchors", turn_anchors(a["lat"], a["lon"], b["lat"], b["lon"], az0, az1))


def anchor_of(signs: DataFrame, col: str = "number") -> DataFrame:
    """anchor: which of a turn's anchors a sign's position takes."""
    table = F.create_map(*[F.lit(x) for kv in TURN_ANCHORS.items() for x in kv])
    return signs.withColumn("anchor", F.coalesce(F.element_at(table, F.col(col)), F.lit("start")))
