"""Road ways from a map service's JSON, and other small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.tables import numbered

ELEMENT = "struct<type:string,id:bigint,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>"


def read_roads(spark: SparkSession, path: str, highways: tuple[str, ...] | None = None) -> DataFrame:
    """way_id, name, highway, nodes of ways with at least two nodes."""
    raw = spark.read.option("multiLine", True).schema(f"elements array<{ELEMENT}>").json(path)
    e = raw.select(F.explode("elements").alias("e")).where((F.col("e.type") == "way") & (F.size("e.geometry") >= 2))
    out = e.select(F.col("e.id").alias("way_id"), F.coalesce(F.element_at("e.tags", "name"), F.lit("")).alias("name"), F.element_at("e.tags", "highway").alias("highway"), F.col("e.geometry").alias("nodes"))
    return out.where(F.col("highway").isin(*highways)) if highways else out


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case names, one a line; empty lines go."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("name")).where("name <> ''")


def frame_count(videos: DataFrame) -> DataFrame:
    """total frames of the videos (video, frame_count) that could be opened; the others have null counts."""
    return videos.agg(F.coalesce(F.sum("frame_count"), F.lit(0)).alias("frames"))


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    """video (from 0, by name), name_video, path, bytes of a folder's .mp4 files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][pP]4").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name_video"), "path", F.col("length").alias("bytes"))
    return numbered(files, ["name_video", "path"], "video").select("video", "name_video", "path", "bytes")
