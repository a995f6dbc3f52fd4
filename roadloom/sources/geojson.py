"""Feature collections, read and written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Property names of a stored feature; all are text but the code.
_TEXT = ("type", "length", "side", "turn", "left", "num", "pixel_coordinates_x", "pixel_coordinates_y", "h", "w", "car_coordinates_x", "car_coordinates_y", "frame_numbers", "absolute_frame_numbers", "azimuth", "id", "time", "name_video", "MVALUE", "SEM250")
PROPERTIES = "struct<" + ",".join(f"{c}:string" for c in _TEXT) + ",code:bigint>"
FEATURE = f"struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:{PROPERTIES}>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """type, geometry, properties of each feature of one collection, with seq for their order."""
    raw = spark.read.option("multiLine", True).schema(f"type string, features array<{FEATURE}>").json(path)
    return raw.select(F.posexplode("features").alias("seq", "f")).select("seq", "f.*")


def flat(features: DataFrame) -> DataFrame:
    """Properties as columns, for review and edits."""
    return features.select(*[c for c in ("seq",) if c in features.columns], "properties.*", "geometry")


def write_geojson(features: DataFrame, path: str) -> None:
    """One collection as one text file in a folder that replaces path in one rename.

    A collection is a single JSON document, so this sink is one task; it is meant for the deduplicated layer. Large
    layers go to Parquet or to JSON lines (write_features).
    """
    spark = features.sparkSession
    rows = features.select(F.to_json(F.struct("type", "geometry", "properties")).alias("value"))
    body = rows.agg(F.array_join(F.collect_list("value"), ",").alias("b")).select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "b", F.lit("]}")).alias("value"))
    fresh = f"{path}.{uuid.uuid4().hex}"
    body.coalesce(1).write.text(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs
    to, new = hadoop.Path(path), hadoop.Path(fresh)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(to, True)
    fs.rename(new, to)


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line, in as many files as there are partitions."""
    features.select("type", "geometry", "properties").write.mode("overwrite").json(path)


def empty_features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"f {FEATURE}").select("f.*")
