"""Votes, scores and positions of tracks, from one row for each observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.catalog import CITY_CLASSES
from roadloom.functions.geo import azimuth_apart, to_utm
from roadloom.params import DEFAULT, Params


def mode_vote(obs: DataFrame, keys: list[str], value: str, order: str, out: str = "best") -> DataFrame:
    """The commonest value of each group and its count; ties go to the value seen first."""
    counts = obs.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col("_n").alias("n")), F.struct(F.col("_n"), -F.col("_first")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(out), F.col("_b.n").alias(f"{out}_count"))


def observations(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Number of observations and the side vote: lateral if more than half say so."""
    return obs.groupBy(*keys).agg(F.count("*").alias("observations"), (F.sum(F.col("is_side").cast("int")) * 2 > F.count("*")).alias("is_side"))


def stability(obs: DataFrame, keys: list[str]) -> DataFrame:
    """1 for a steady x, 0 from a deviation of 150 pixels; 0.5 with a single observation."""
    return obs.groupBy(*keys).agg(F.when(F.count("x") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop("x") / 150)).alias("stability"))


def confidence(mode_count: Column, n: Column, track: Column, snap_m: Column, azimuth_apart_: Column) -> tuple[Column, Column, Column]:
    """(class share, placement, total). snap_m < 0 or null: not measured; a null angle: unknown."""
    share = F.when(n > 0, mode_count / n).otherwise(0.0)
    length = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n - 4) / 16))
    snap = F.when(snap_m.isNull() | (snap_m < 0), 0.5).when(snap_m <= 5, 1.0).when(snap_m <= 30, 1 - (snap_m - 5) / 25).otherwise(0.0)
    azimuth = F.when(azimuth_apart_.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - azimuth_apart_ / 45))
    placement = 0.30 * track + 0.25 * length + 0.25 * snap + 0.20 * azimuth
    return share, placement, 0.5 * share + 0.5 * placement


def confidence_label(total: Column) -> Column:
    return F.when(total >= 0.75, "high").when(total >= 0.50, "medium").when(total >= 0.30, "low").otherwise("very low")


def side_from_motion(obs: DataFrame, keys: list[str], order: str, params: Params = DEFAULT) -> DataFrame:
    """is_left: the sign moved left across the screen; with one observation, by its place."""
    third = params.screen_width / 3
    one = (params.screen_width - F.col("w") <= third) == (params.screen_width - F.col("x") <= third)
    return obs.groupBy(*keys).agg(F.when(F.count("*") == 1, F.min_by(one, order)).otherwise(F.min_by("x", order) > F.max_by("x", order)).alias("is_left"))


def collapse_positions(obs: DataFrame, keys: list[str], order: str, east: str = "car_e") -> DataFrame:
    """Observations whose easting differs from the one before."""
    before = F.lag(east).over(Window.partitionBy(*keys).orderBy(order))
    return obs.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(east))).drop("_before")


def displacement(obs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pixels from the observation before, half-even to one decimal; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return obs.withColumn("moved", F.coalesce(F.bround(d, 1), F.lit(0.0)))


def accumulate(obs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Parallel arrays of a track's observations, in order; texts only where they aren't empty."""
    fields = ["x", "y", "w", "h", "car_e", "car_n", "frame_number", "abs_frame", "name_sign", "number_sign", "is_side", "text"]
    own = [c for c in fields if c in obs.columns]
    rows = obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in own if c != order]))).alias("_o"))
    field = lambda c: F.transform("_o", lambda s: s[c])
    out = {c: field(c) for c in own}
    if "text" in out:
        out["text"] = F.filter(out["text"], lambda t: F.coalesce(t, F.lit("")) != "")
    return rows.select(*keys, *[c.alias(f"{n}s") for n, c in out.items()])


def merge_tracks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of two track tables one after the other."""
    other = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in b.columns if c not in keys])
    return a.join(other, keys, "left").select(*keys, *[F.concat(c, F.coalesce(f"_{c}", F.slice(c, 1, 0))).alias(c) for c in a.columns if c not in keys])


def median_box(obs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Box of the observation in the middle of the order of arrival (place n // 2 from 0)."""
    rows = obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "x", "y", "w", "h"))).alias("_o"))
    mid = F.element_at("_o", (F.floor(F.size("_o") / 2) + 1).cast("int"))
    return rows.select(*keys, *[mid[c].alias(f"mid_{c}") for c in ("x", "y", "w", "h")])


def city_score(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The name with the largest sum of accuracies; ties go to the name seen first. texts: keys, seq, name, accuracy."""
    sums = texts.groupBy(*keys, "name").agg(F.sum("accuracy").alias("_s"), F.min("seq").alias("_f"))
    return sums.groupBy(*keys).agg(F.max_by("name", F.struct(F.col("_s"), -F.col("_f"))).alias("city"))


def feature_text(tracks: DataFrame) -> DataFrame:
    """text of a feature: the city for city classes, the commonest text of more than four, else empty."""
    return tracks.withColumn("text", F.when(F.col("name_sign").isin(*CITY_CLASSES), F.coalesce("city", F.lit(""))).when(F.size("texts") > 4, F.coalesce("best_text", F.lit(""))).otherwise(""))


def split_on_turn(tracks: DataFrame, turns: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(straight, on the turn) of tracks; both have turn_id, the first turn whose frames a track's frames meet.

    A track with enough votes that was last seen before its turn ended is on the turn. The others are straight; those
    that meet a turn take its last point as their place, and tracks without a turn stay as they are (turn_id null).
    turns: drive_id, turn_id, frames, coordinates (structs lat, lon), in order.
    """
    ends = turns.where(F.size("frames") > 0).select("drive_id", "turn_id", F.element_at("frames", 1).alias("_start"), F.element_at("frames", -1).alias("_end"), F.try_element_at("coordinates", F.lit(-1)).alias("_at"))
    held = tracks.select("drive_id", "track_id", "first_frame", "last_frame").join(ends, "drive_id").where("first_frame <= _end and last_frame >= _start")
    held = held.groupBy("drive_id", "track_id").agg(F.min(F.struct("turn_id", "_end", "_at")).alias("_t"))
    both = tracks.join(held, ["drive_id", "track_id"], "left").withColumns({"turn_id": F.col("_t.turn_id"), "_on": F.coalesce((F.col("mode_count") >= params.turn_observations) & (F.col("last_frame") < F.col("_t._end")), F.lit(False))})
    place = {c: F.coalesce(F.col(f"_t._at.{c}"), F.col(c)) for c in ("lat", "lon")}
    e, n = to_utm(place["lat"], place["lon"])
    moved = F.col("_t._at").isNotNull()
    straight = both.where(~F.col("_on")).withColumns(place | {"car_e": F.when(moved, e).otherwise(F.col("car_e")), "car_n": F.when(moved, n).otherwise(F.col("car_n"))})
    return straight.drop("_t", "_on"), both.where("_on").drop("_t", "_on")


def track_azimuth_apart(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), azimuth_apart(a, b))
