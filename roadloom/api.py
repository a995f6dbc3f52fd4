"""Query and edit functions over features; every function returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.catalog import TYPES_WITH_TEXT, sign_codes, sign_names


def _property(features: DataFrame, name: str, kind: str, default) -> F.Column:
    own = name in features.schema["properties"].dataType.names
    return F.coalesce(F.col(f"properties.{name}").cast(kind), F.lit(default)) if own else F.lit(default).cast(kind)


def track(gps: DataFrame) -> DataFrame:
    """[lat, lon] of each point, in order."""
    return gps.orderBy("drive_id", "idx").select(F.array("lat", "lon").alias("point"))


def signs(features: DataFrame) -> DataFrame:
    """The map's columns; features without coordinates are skipped. A missing id is a hash of the feature."""
    p = lambda name, kind="string", default="": _property(features, name, kind, default)
    line = F.col("geometry.coordinates")
    kept = features.where(F.coalesce(F.size(line), F.lit(0)) > 0)
    made = F.substring(F.sha2(F.to_json(F.struct("geometry", "properties")), 256), 1, 32)
    return kept.select(
        F.coalesce(F.nullif(p("id"), F.lit("")), made).alias("id"), p("type").alias("type"), p("code", "long", 0).alias("code"), p("azimuth", "string", "0").alias("azimuth"), p("SEM250").alias("description"), p("side").alias("side"), p("left").alias("left"),
        p("time").alias("time"), p("name_video").alias("name_video"), p("absolute_frame_numbers").alias("abs_frame"), line[0][1].alias("lat"), line[0][0].alias("lon"), line.alias("line"),
    )


def map_filter(signs_: DataFrame, type_text: str = "", side: str = "all") -> DataFrame:
    """Signs whose type holds a text, on a side: all, left or right."""
    out = signs_.where(F.col("type").contains(type_text))
    return out if side == "all" else out.where(F.lower("left") == ("true" if side == "left" else "false"))


def sign(features: DataFrame, sign_id: str) -> DataFrame:
    return features.where(F.col("properties.id") == sign_id).limit(1)


def update(flat: DataFrame, sign_id: str, new_type: str | None = None, description: str | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Flat features with one sign changed: type, its code if known, and the text pair if the type has one."""
    codes = sign_codes(flat.sparkSession) if codes is None else codes
    hit = F.col("id") == sign_id
    kind = F.when(hit, F.coalesce(F.lit(new_type), F.col("type"))).otherwise(F.col("type"))
    text = F.coalesce(F.lit(description), F.col("SEM250"), F.lit(""))
    out = flat.withColumn("type", kind).join(F.broadcast(codes.select("type", F.col("code").cast("long").alias("_code"))), "type", "left")
    pair = lambda old: F.when(hit, F.when(F.col("type").isin(*TYPES_WITH_TEXT), text)).otherwise(F.col(old)).alias(old)
    own = {"code": F.when(hit, F.coalesce("_code", "code")).otherwise(F.col("code")).alias("code"), "SEM250": pair("SEM250"), "MVALUE": pair("MVALUE")}
    return out.select(*[own.get(c, F.col(c)) for c in flat.columns])


def delete(features: DataFrame, ids: DataFrame) -> DataFrame:
    return features.join(ids.select("id").distinct(), "id", "left_anti")


def sign_types(spark: SparkSession, text: str = "") -> DataFrame:
    """type, name, code of named types, by type; text is looked for in the label and the code."""
    both = sign_names(spark).join(sign_codes(spark), "type").where(F.lower("name").contains(text.lower()) | F.col("type").contains(text) | F.col("code").contains(text))
    return both.select("type", "name", F.col("code").cast("long").alias("code")).orderBy("type")


def export(features: DataFrame, path: str) -> str:
    """Write the layer as one collection under path and say where; an empty layer is an error, as there is nothing to give."""
    from roadloom.sources.geojson import write_geojson

    if features.isEmpty():
        raise FileNotFoundError("no features to export")
    write_geojson(features, path)
    return path


def jump(frame_seconds: int, frames_per_second: int = 60) -> int:
    """The absolute frame that a position in seconds means."""
    return frame_seconds * frames_per_second
