"""Cleaning of the detections of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.catalog import DROPPED_CLASS, LANE_CLASS, RENAMED_CLASSES, TYPES_WITH_TEXT, CITY_CLASSES
from roadloom.functions.scalars import box_overlap, top_class
from roadloom.params import DEFAULT, Params


def inside(at: str, size: str, limit: int) -> Column:
    """How much of a box lies between 0 and the frame's limit, along one axis."""
    return F.least(F.col(at) + F.col(size), F.lit(limit)) - F.greatest(F.col(at), F.lit(0))


def detected(raw: DataFrame) -> DataFrame:
    """The stored detection of raw ones (box struct of x, y, w, h; other columns): null texts are empty, a null side is false."""
    b = F.col("box")
    return raw.select(*[c for c in ("det_id", "drive_id") if c in raw.columns], *[b[c].cast("int").alias(c) for c in "xywh"], "name_sign", "number_sign", "frame_number", "absolute_frame_number", "car_e", "car_n", F.coalesce("text", F.lit("")).alias("text_on_sign"), F.coalesce("is_side", F.lit(False)).alias("is_side"))


def confident(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Boxes and coarse classes that are sure enough, with an area inside the frame."""
    return raw.where((F.col("box_confidence") >= params.box_confidence) & (F.col("coarse_confidence") >= params.coarse_confidence) & (inside("x", "w", params.screen_width) > 0) & (inside("y", "h", params.screen_height) > 0))


def boxes(raw: DataFrame) -> DataFrame:
    """x1, y1, x2, y2 and the side class (0 is lateral) as x, y, w, h, is_side."""
    kept = [c for c in raw.columns if c not in ("x1", "y1", "x2", "y2", "side_class")]
    return raw.select(*kept, F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), (F.col("side_class") == 0).alias("is_side"))


def normalise_classes(detections: DataFrame, col: str = "name_sign") -> DataFrame:
    """Drop the class that isn't tracked and rename old names."""
    name = F.col(col)
    for old, new in RENAMED_CLASSES.items():
        name = F.when(F.col(col) == old, new).otherwise(name)
    return detections.where(F.col(col) != DROPPED_CLASS).withColumn(col, name)


def fine_class(raw: DataFrame, with_model: list[str], classes: dict[str, list[str]], params: Params = DEFAULT) -> DataFrame:
    """number_sign of detections: the surest fine class where the coarse class has a model, the lane string for
    lane signs, else the coarse class. Detections whose fine class isn't sure enough go.

    raw has name_sign, fine_probabilities (array<double>) and lane_type (string).
    """
    p = F.col("fine_probabilities")
    table = F.create_map(*[x for k in with_model for x in (F.lit(k), F.array(*[F.lit(c) for c in classes[k]]))]) if with_model else F.lit(None).cast("map<string,array<string>>")
    fine = F.when(F.array_max(p) >= params.fine_confidence, F.get(F.element_at(table, F.col("name_sign")), top_class(p)))
    number = F.when(F.col("name_sign").isin(*with_model), fine).when(F.col("name_sign") == LANE_CLASS, F.col("lane_type")).otherwise(F.col("name_sign"))
    return raw.withColumn("number_sign", number).where("number_sign is not null and number_sign <> '-1'")


def text_route(detections: DataFrame) -> DataFrame:
    """Which reader gives a detection's text: `line` (first line), `city` (dictionary) or none."""
    return detections.withColumn("text_route", F.when(F.col("number_sign").isin(*TYPES_WITH_TEXT), "line").when(F.col("name_sign").isin(*CITY_CLASSES), "city"))


def inframe_dedup(detections: DataFrame, frame: str = "frame_number", params: Params = DEFAULT) -> DataFrame:
    """Detections without the smaller of two boxes of one coarse class that overlap in one frame.

    The share is of the earlier box (by det_id); on equal areas the later one goes. A self join on (drive, frame,
    class): groups are the few boxes of one frame.
    """
    keys = ["drive_id", frame, "name_sign"]
    box = ["det_id", "x", "y", "w", "h"]
    a = detections.select(*keys, *[F.col(c).alias(f"a_{c}") for c in box])
    b = detections.select(*keys, *[F.col(c).alias(f"b_{c}") for c in box])
    over = box_overlap(*[F.col(f"a_{c}") for c in box[1:]], *[F.col(f"b_{c}") for c in box[1:]]) > params.overlap_percent
    loser = F.when(F.col("a_w") * F.col("a_h") < F.col("b_w") * F.col("b_h"), F.col("a_det_id")).otherwise(F.col("b_det_id"))
    gone = a.join(b, keys).where((F.col("a_det_id") < F.col("b_det_id")) & over).select(loser.alias("det_id")).distinct()
    return detections.join(gone, "det_id", "left_anti")


def nearest_match(frames: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Matches of tracks and detections of one frame by nearest box, one detection to one track.

    frames: drive_id, frame, track_id, track_class, track_x, track_y, det_id, det_class, det_x, det_y for each pair of a
    frame. Returns drive_id, frame, track_id, det_id, distance, match. A track takes its nearest detection; of tracks
    that want one detection the one of the same class wins, then the nearer, then the earlier.
    """
    from pyspark.sql import Window

    same = F.col("track_class") == F.col("det_class")
    moved = F.bround(F.sqrt(F.pow(F.col("det_x") - F.col("track_x"), 2) + F.pow(F.col("det_y") - F.col("track_y"), 2)), 1)
    distance = moved + F.when(same, -params.same_class_bonus).otherwise(params.other_class_penalty)
    valid = frames.withColumn("match", same).withColumn("distance", distance).where((F.col("det_y") - F.col("track_y") <= params.most_drop) & (F.col("distance") <= params.most_pixels))
    per_track = Window.partitionBy("drive_id", "frame", "track_id").orderBy("distance", "det_id")
    per_det = Window.partitionBy("drive_id", "frame", "det_id").orderBy(F.desc("match"), "distance", "track_id")
    first = valid.withColumn("_r", F.row_number().over(per_track)).where("_r = 1")
    return first.withColumn("_r", F.row_number().over(per_det)).where("_r = 1").select("drive_id", "frame", "track_id", "det_id", "distance", "match")
