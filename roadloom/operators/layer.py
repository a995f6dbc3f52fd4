"""From tracks and turns to the stored layer of sign features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.catalog import TYPES_WITH_TEXT
from roadloom.functions import geo
from roadloom.functions.scalars import bool_text, list_text
from roadloom.operators import dedup, features, snap, tracker, tracks, turns
from roadloom.params import DEFAULT, Params
from roadloom.sources.layers import write_layer
from roadloom.tables import checkpointed, numbered

#: Stored lists and the columns of tracks that they hold.
LISTS = {"pixel_coordinates_x": "xs", "pixel_coordinates_y": "ys", "h": "hs", "w": "ws", "car_coordinates_x": "car_es", "car_coordinates_y": "car_ns", "frame_numbers": "frames", "absolute_frame_numbers": "abs_frames"}


def commonest(values: str | Column) -> Column:
    """The commonest value of an array, the first of equals; null of an empty one."""
    v = F.col(values) if isinstance(values, str) else values
    counted = F.transform(F.array_distinct(v), lambda t: F.struct(F.size(F.filter(v, lambda x: x == t)).alias("n"), (-F.array_position(v, t)).alias("first"), t.alias("value")))
    return F.array_max(counted)["value"]


def stored(rows: DataFrame, videos: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """type, geometry and the 21 stored properties of tracks with code, lat1, lon1, lat2, lon2; other columns stay.

    All properties are text but the code. time and name_video are those of the mean absolute frame; texts are kept for
    types with text: the city of a city class, else the commonest of more than four. The id is a hash of the track and
    its line, so that a rerun gives the same one. videos: video (from 0), name_video.
    """
    mean = F.when(F.size("abs_frames") > 0, F.aggregate("abs_frames", F.lit(0).cast("long"), lambda s, x: s + x) / F.size("abs_frames")).otherwise(0.0)
    best = commonest("texts")
    named = tracks.feature_text(rows.withColumns({"mean_frame": mean, "city": best, "best_text": best}))
    placed = features.video_columns(named, videos, params=params)
    text = F.when(F.col("number_sign").isin(*TYPES_WITH_TEXT), F.col("text"))
    flags = list_text(F.transform("sides", bool_text))
    props = F.struct(
        F.col("number_sign").alias("type"), F.col("observations").cast("string").alias("length"), flags.alias("side"), F.col("turn_direction").alias("turn"), bool_text(F.col("is_left")).alias("left"), F.col("num").cast("string").alias("num"),
        *[list_text(F.col(c)).alias(name) for name, c in LISTS.items()], F.col("azimuth").cast("string").alias("azimuth"),
        F.substring(F.sha2(F.concat_ws("|", "drive_id", "track_id", "number_sign", "lat1", "lon1"), 256), 1, 32).alias("id"), "time", "name_video", text.alias("MVALUE"), text.alias("SEM250"), "code",
    )
    line = F.array(F.array("lon1", "lat1"), F.array("lon2", "lat2"))
    made = placed.withColumns({"geometry": F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")), "properties": props, "type": F.lit("Feature")})
    return made.drop("mean_frame", "city", "best_text", "text", "time", "name_video")


def straight_lines(rows: DataFrame, segs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Tracks along the road with their slots, the azimuth of the road that they stand at, and lines."""
    signs = features.expand_lanes(rows.drop("coordinates", "azimuths")).withColumn("point_id", F.struct("drive_id", "track_id"))
    at = signs.select("point_id", "lat", "lon").dropDuplicates(["point_id"])  # lane signs share theirs
    near = snap.snap(at, segs, params).select("point_id", "snapped", "road_azimuth")
    turned = features.slots(signs, ["drive_id", "track_id", "number_sign"]).join(near, "point_id").withColumn("azimuth", F.when(F.col("snapped"), F.col("road_azimuth")).otherwise(F.col("azimuth")))
    return features.lines(turned, params).drop("point_id", "snapped", "road_azimuth")


def turn_lines(rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """Tracks that left on a turn, with their slots and lines off the turn's anchors."""
    at = turns.anchors(turn_rows.select("drive_id", "turn_id", "coordinates", "azimuths"))
    own = rows.drop("coordinates", "azimuths", "azimuth")
    return features.turn_lines(features.turn_slots(own, ["track_id"]), at)


def sign_layer(detections: DataFrame, segs: DataFrame, videos: DataFrame, codes: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """Detections of drives to the stored layer: type, geometry, properties, one row a sign.

    Tracks and turns; tracks along the road on their slots and roads, tracks of turns off the anchors; known types only;
    duplicates within the radius go, those of turns after those along the road. segs: snap.segments(); videos: video,
    name_video; codes: type, code (the catalogue's, if not given).
    """
    rows = checkpointed(tracker.tracks_and_turns(detections, params))
    signs = rows.where("kind = 'track'")
    straight = straight_lines(signs.where("turn_id is null"), segs, params)
    on_turn = turn_lines(signs.where("turn_id is not null"), rows.where("kind = 'turn'"))
    both = features.union_layers(straight, on_turn.select(*straight.columns))
    known = stored(features.with_code(both, codes), videos, params)
    e, n = geo.to_utm(F.col("lat1"), F.col("lon1"))
    # one pass gives the order of arrival; the dedup reads it again and again
    ordered = numbered(known.withColumns({"e": e, "n": n}), ["part", "drive_id", "track_id", "number_sign"], "seq")
    flat = checkpointed(ordered.select("seq", "type", "geometry", "properties", "is_left", "e", "n", F.col("properties.azimuth").cast("double").alias("azimuth"), F.col("observations").alias("length")))
    slim = flat.select("seq", F.col("properties.type").alias("type"), "is_left", "e", "n", "azimuth", "length")
    kept = dedup.grid_dedup(slim, params).select("seq")
    return flat.join(kept, "seq", "left_semi").select("type", "geometry", "properties")


def save(detections: DataFrame, segs: DataFrame, videos: DataFrame, path: str, codes: DataFrame | None = None, params: Params = DEFAULT) -> str:
    """Detections to the layer at path, which is swapped whole; the new version's folder."""
    return write_layer(sign_layer(detections, segs, videos, codes, params), path)
