"""Frames and GPS points: which point belongs to a frame, and which frames are looked at."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.scalars import adaptive_step
from roadloom.params import DEFAULT, Params


def gps_index(abs_frame: Column, start: Column | int = 0, every: int = 60) -> Column:
    """Index of the GPS point that the reader has reached at an absolute frame >= 1."""
    first = F.bround((F.lit(start) if isinstance(start, int) else start) / every, 0).cast("long")
    return F.greatest(first, F.floor((abs_frame - 1) / every).cast("long"))


def align(frames: DataFrame, gps: DataFrame, start: int = 0, ahead: int = 1, params: Params = DEFAULT) -> DataFrame:
    """frames with the GPS row `ahead` of their index (1: position, 2: azimuth), clamped to the drive's last.

    frames: drive_id, abs_frame, ...; gps: drive_id, idx, lat, lon, course, speed, elevation. Frames of drives
    without points keep their row with zeros.
    """
    last = gps.groupBy("drive_id").agg(F.max("idx").alias("_last"))
    keyed = frames.withColumn("gps_index", gps_index(F.col("abs_frame"), start, params.frames_per_point)).join(last, "drive_id", "left").withColumn("idx", F.least(F.col("gps_index") + ahead, F.col("_last")))
    out = keyed.join(gps, ["drive_id", "idx"], "left").drop("_last", "idx")
    values = [c for c in gps.columns if c not in ("drive_id", "idx")]
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in values})


def previous(frames: DataFrame, gps: DataFrame) -> DataFrame:
    """frames (drive_id, gps_index) with prev_lat and prev_lon: the point max(0, index), (0, 0) past the end."""
    at = gps.select("drive_id", F.col("idx").alias("_i"), F.col("lat").alias("prev_lat"), F.col("lon").alias("prev_lon"))
    out = frames.withColumn("_i", F.greatest(F.lit(0), "gps_index")).join(at, ["drive_id", "_i"], "left").drop("_i")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("prev_lat", "prev_lon")})


def throughput(frames: DataFrame, keys: list[str], params: Params = DEFAULT) -> DataFrame:
    """Frames, moving frames and the progress in percent of a video's frames, for each of the keys."""
    seen = frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.sum((F.col("speed") >= params.stationary_speed).cast("int")).alias("moving"), F.max("frame_number").alias("_last"))
    return seen.withColumn("progress", progress(F.col("_last"), F.lit(params.frames_per_video))).drop("_last")


def progress(at: Column, total: Column) -> Column:
    """Percent of total, cut to an integer; 0 without a total."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.floor(at * 100.0 / total)).otherwise(0).cast("int")


def every_nth(frames: DataFrame, step: int, params: Params = DEFAULT) -> DataFrame:
    """Each video's frames number step, 2 * step, ..."""
    return frames.where(F.col("frame_number") % step == 0)


def moving(frames: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return frames.where(F.col("speed") >= params.stationary_speed)


def adaptive_frames(frames: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Frames (drive_id, frame_number, speed, ...) that a sampler takes whose step follows the speed.

    A fold over each drive: a taken frame with a speed of at least the stationary limit sets the next step.
    The step takes effect at once, so results don't depend on thread timing.
    """
    stepped = frames.withColumn("_step", F.coalesce(adaptive_step(F.col("speed")), F.lit(0)))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_number", kind="stable")
        keep, step, since = np.zeros(len(pdf), bool), params.frame_step, 0
        for i, (speed, wanted) in enumerate(zip(pdf["speed"].fillna(0.0), pdf["_step"])):
            since += 1
            if since >= step:
                keep[i], since = True, 0
                if speed >= params.stationary_speed and wanted:
                    step = int(wanted)
        return pdf[keep].drop(columns="_step")

    return stepped.groupBy("drive_id").applyInPandas(take, frames.schema)


def located(detections: DataFrame, gps: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Detections (drive_id, abs_frame, ...) with what the tracker needs of the car: lat, lon, car_e, car_n, course.

    The place is the frame's GPS point, the course the next one's, as the tracker refreshes azimuths. gps: as align()
    takes it. Columns of these names are replaced.
    """
    from roadloom.functions.geo import to_utm

    made = ["lat", "lon", "car_e", "car_n", "course", "gps_index"]
    frames = detections.select("drive_id", "abs_frame").distinct()
    place = align(frames, gps, params=params).select("drive_id", "abs_frame", "gps_index", "lat", "lon")
    course = align(frames, gps, ahead=2, params=params).select("drive_id", "abs_frame", "course")
    e, n = to_utm(F.col("lat"), F.col("lon"))
    at = place.join(course, ["drive_id", "abs_frame"]).withColumns({"car_e": e, "car_n": n})
    return detections.drop(*made).join(at, ["drive_id", "abs_frame"])
