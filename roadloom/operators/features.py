"""Sign features from tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.catalog import LANE_CLASS, sign_codes
from roadloom.functions import geo
from roadloom.operators import turns as turns_
from roadloom.functions.scalars import time_text
from roadloom.params import DEFAULT, Params


def expand_lanes(tracks: DataFrame) -> DataFrame:
    """One row for each distinct type of a lane sign, on the right; other tracks as they are."""
    lane = F.col("name_sign") == LANE_CLASS
    kinds = F.when(lane, F.array_distinct(F.split("number_sign", "-"))).otherwise(F.array("number_sign"))
    out = tracks.withColumn("_kind", F.explode(kinds))
    return out.withColumns({"number_sign": F.col("_kind"), "name_sign": F.when(lane & F.col("number_sign").contains("-"), F.col("_kind")).otherwise(F.col("name_sign")), "is_left": F.when(lane, F.lit(False)).otherwise(F.col("is_left"))}).drop("_kind")


def slots(tracks: DataFrame, order: list[str], east: str = "car_e") -> DataFrame:
    """slot: place on a pole from 2, among tracks with one rounded easting and side, in the order of arrival."""
    w = Window.partitionBy(F.bround(east, 0), "is_left").orderBy(*order)
    return tracks.withColumn("slot", F.row_number().over(w) + 1)


def union_layers(straight: DataFrame, turn: DataFrame) -> DataFrame:
    """Features along the road, then those of turns, with `part` saying which."""
    return straight.withColumn("part", F.lit("straight")).unionByName(turn.withColumn("part", F.lit("turn")))


def with_name(rows: DataFrame, names: DataFrame, key: str, default: str = "") -> DataFrame:
    """rows with the name of their key, or the default. names: key, name; the first by name of repeated keys."""
    one = names.groupBy(key).agg(F.min("name").alias("name"))
    return rows.join(one, key, "left").withColumn("name", F.coalesce("name", F.lit(default)))


def turn_slots(signs: DataFrame, order: list[str]) -> DataFrame:
    """slot from 2 of a turn's signs at each position (number), in the order of arrival; lane signs go."""
    w = Window.partitionBy("drive_id", "turn_id", F.col("number").cast("string")).orderBy(*order)
    return signs.where(F.col("name_sign") != LANE_CLASS).withColumn("slot", F.row_number().over(w) + 1)


def turn_lines(signs: DataFrame, turns: DataFrame) -> DataFrame:
    """lat1, lon1, lat2, lon2 and azimuth of signs on a turn: from the anchor of their position, by their slot.

    signs: drive_id, turn_id, number, slot, is_side, is_left; turns as anchors() gives them, with the same keys.
    """
    at = turns_.anchor_of(signs).join(turns.select("drive_id", "turn_id", "anchors"), ["drive_id", "turn_id"])
    pick = lambda c: F.when(F.col("anchor") == "start", F.col(f"anchors.start.{c}")).when(F.col("anchor") == "rev_end", F.col(f"anchors.rev_end.{c}")).otherwise(F.col(f"anchors.rev_start.{c}"))
    out = at.withColumns({"_lat": pick("lat"), "_lon": pick("lon"), "_blat": pick("lat2"), "_blon": pick("lon2"), "azimuth": pick("azimuth")})
    e, n = geo.to_utm(F.col("_lat"), F.col("_lon"))
    be, bn = geo.to_utm(F.col("_blat"), F.col("_blon"))
    out = out.withColumns({"_e": e, "_n": n, "_be": be, "_bn": bn})
    e1, n1, e2, n2 = geo.sign_line(F.col("_e"), F.col("_n"), F.col("_be"), F.col("_bn"), F.col("slot"), F.col("is_side"), F.col("is_left"))
    out = out.withColumns({"_e1": e1, "_n1": n1, "_e2": e2, "_n2": n2})
    a, b = geo.from_utm(F.col("_e1"), F.col("_n1")), geo.from_utm(F.col("_e2"), F.col("_n2"))
    made = out.withColumns({"lat1": a[0], "lon1": a[1], "lat2": b[0], "lon2": b[1]})
    return made.drop("anchors", "anchor", "_lat", "_lon", "_blat", "_blon", "_e", "_n", "_be", "_bn", "_e1", "_n1", "_e2", "_n2")


def lines(tracks: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """lat1, lon1, lat2, lon2 of each track's line and its final azimuth.

    tracks: car_e, car_n, azimuth, slot, is_side, is_left. The azimuth turns sideways after the line is made.
    """
    # step by step, so that no expression holds another one many times
    lat, lon = geo.from_utm(F.col("car_e"), F.col("car_n"))
    out = tracks.withColumns({"_lat": lat, "_lon": lon})
    back = geo.destination(F.col("_lat"), F.col("_lon"), F.pmod(F.col("azimuth") + 180, F.lit(360.0)), params.line_m)
    out = out.withColumns({"_blat": back[0], "_blon": back[1]})
    be, bn = geo.to_utm(F.col("_blat"), F.col("_blon"))
    out = out.withColumns({"_be": be, "_bn": bn})
    e1, n1, e2, n2 = geo.sign_line(F.col("car_e"), F.col("car_n"), F.col("_be"), F.col("_bn"), F.col("slot"), F.col("is_side"), F.col("is_left"))
    out = out.withColumns({"_e1": e1, "_n1": n1, "_e2": e2, "_n2": n2})
    a, b = geo.from_utm(F.col("_e1"), F.col("_n1")), geo.from_utm(F.col("_e2"), F.col("_n2"))
    out = out.withColumns({"lat1": a[0], "lon1": a[1], "lat2": b[0], "lon2": b[1]})
    return out.withColumn("azimuth", F.when(F.col("is_side"), geo.lateral_azimuth(F.col("azimuth"), F.col("is_left"))).otherwise(F.col("azimuth"))).drop("_lat", "_lon", "_blat", "_blon", "_be", "_bn", "_e1", "_n1", "_e2", "_n2")


def with_code(tracks: DataFrame, codes: DataFrame | None = None, col: str = "number_sign") -> DataFrame:
    """code of each type; tracks of unknown types go."""
    codes = sign_codes(tracks.sparkSession) if codes is None else codes
    return tracks.join(F.broadcast(codes.select(F.col("type").alias(col), F.col("code").cast("long").alias("code"))), col)


def video_columns(tracks: DataFrame, videos: DataFrame, mean_frame: str = "mean_frame", params: Params = DEFAULT) -> DataFrame:
    """name_video and time of the mean absolute frame. videos: video (from 0), name_video."""
    out = tracks.withColumn("video", F.floor(F.col(mean_frame) / params.frames_per_video).cast("long"))
    local = F.floor(F.pmod(F.col(mean_frame), F.lit(float(params.frames_per_video)))).cast("long")
    return out.join(videos, "video", "left").withColumns({"name_video": F.coalesce("name_video", F.lit("unknown")), "time": time_text(local)}).drop("video")
