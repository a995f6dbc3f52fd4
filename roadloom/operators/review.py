"""Review of features: records, listings and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.catalog import TYPES_WITH_TEXT
from roadloom.functions.scalars import ints_in, is_true, length_or_zero, video_frame


def records(features: DataFrame) -> DataFrame:
    """One record a feature with a type: confidence from length and frames, middle box, video place. features are
    flat: id, type, length, left and the stored lists as text."""
    frames = ints_in(F.col("frame_numbers"))
    n = F.size(frames)
    length = F.when(F.coalesce(F.col("length"), F.lit("")) == "", n).otherwise(length_or_zero(F.col("length")))
    boxes = [ints_in(F.col(c)) for c in ("pixel_coordinates_x", "pixel_coordinates_y", "w", "h")]
    mid = F.floor(F.size(boxes[0]) / 2).cast("int")
    full = (F.size(boxes[0]) > 0) & (F.size(boxes[1]) > 0) & (F.size(boxes[2]) > 0) & (F.size(boxes[3]) > 0)
    absolute = ints_in(F.col("absolute_frame_numbers"))
    mean = F.when(F.size(absolute) > 0, F.floor(F.aggregate(absolute, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(absolute)).cast("long"))
    out = features.where("coalesce(type, '') <> ''").withColumns({"confidence": F.when((n == 0) | (length == 0), 0.0).otherwise(F.least(F.lit(1.0), length / F.greatest(n, F.lit(1)))), "is_left": is_true(F.col("left")), "box": F.when(full, F.struct(*[F.get(b, mid).alias(k) for b, k in zip(boxes, "xywh")])), "place": F.when(mean.isNotNull(), video_frame(mean))})
    return out.withColumn("confidence_pct", F.floor(F.col("confidence") * 100).cast("int"))


def listing(recs: DataFrame, text: str = "", low_only: bool = False) -> DataFrame:
    """Records whose type or name holds a text, least sure first; ties keep the order of seq."""
    t = text.lower()
    hit = F.lower("type").contains(t) | F.lower(F.coalesce("name", F.lit(""))).contains(t)
    return recs.where(hit & ((F.col("confidence") < 0.5) if low_only else F.lit(True))).orderBy("confidence", "seq")


def counters(recs: DataFrame) -> DataFrame:
    return recs.agg(F.count_if(~F.col("deleted")).alias("total"), F.count_if(~F.col("deleted") & (F.col("confidence") < 0.5)).alias("low"))


def neighbours(recs: DataFrame, order: list[str]) -> DataFrame:
    """prev_id and next_id of each record; the ends point at themselves, and ties go by id.

    Records are dealt by range and looked up inside their range; only the first and last of each range meet in one group.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    rows = recs.select(F.struct("id").alias("_r"), *[F.col(c).alias(k) for c, k in zip(order, keys)])
    n = int(recs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys, "_r").withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range").orderBy(*keys, "_r")
    near = ranged.withColumns({"_prev": F.lag("_r").over(inside), "_next": F.lead("_r").over(inside)})
    ends = near.withColumn("_group", F.when(F.col("_prev").isNull() | F.col("_next").isNull(), -1).otherwise(F.col("_range")))
    # a range's first record comes before its last
    across = Window.partitionBy("_group").orderBy("_range", F.col("_prev").isNotNull())
    met = ends.withColumns({"_before": F.lag("_r").over(across), "_after": F.lead("_r").over(across)})
    return met.select("_r.id", F.coalesce("_prev", F.when(F.col("_group") == -1, F.col("_before")), "_r")["id"].alias("prev_id"), F.coalesce("_next", F.when(F.col("_group") == -1, F.col("_after")), "_r")["id"].alias("next_id"))


def apply_edits(features: DataFrame, edits: DataFrame, codes: DataFrame) -> DataFrame:
    """Features after edits (id, new_type, new_text, deleted): deleted ones go, others take the new type, its code if
    there is one, and the text if the type has one. Features without an edit stay.

    An edit without a type keeps the feature's, one without a text the feature's text. Several edits of one id: any
    that deletes wins, else the last by seq where edits have one, else the largest (type, text).
    """
    order = F.col("seq") if "seq" in edits.columns else F.struct("new_type", "new_text")
    e = edits.groupBy("id").agg(F.max_by(F.struct("new_type", "new_text"), order).alias("_e"), F.max(F.coalesce("deleted", F.lit(False))).alias("_gone"))
    e = e.select("id", F.col("_e.new_type").alias("new_type"), F.col("_e.new_text").alias("new_text"), "_gone", F.lit(True).alias("_edit"))
    both = features.join(e, "id", "left").where(~F.coalesce("_gone", F.lit(False))).withColumn("_kind", F.coalesce("new_type", "type"))
    both = both.join(codes.select(F.col("type").alias("_kind"), F.col("code").cast("long").alias("_code")).dropDuplicates(["_kind"]), "_kind", "left")
    kind = F.col("_kind")
    text = lambda old: F.when(F.col("_edit"), F.when(kind.isin(*TYPES_WITH_TEXT), F.coalesce("new_text", old))).otherwise(F.col(old))
    changed = {"type": kind, "code": F.when(F.col("new_type").isNotNull(), F.coalesce("_code", "code")).otherwise(F.col("code")), "SEM250": text("SEM250"), "MVALUE": text("MVALUE")}
    return both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in features.columns])
