"""GPX tracks as a table of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.tables import checkpointed

SCHEMA = "_lat double, _lon double, ele double, time string, course double, speed double"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """drive_id (hash of the file), idx (document order), lat, lon, course, speed, elevation; missing values are 0.

    Uses the built-in XML reader. Rows are numbered in each split of a file, from the counts of the splits before, so no task
    orders a whole file that Spark splits.
    """
    raw = spark.read.format("xml").option("rowTag", "trkpt").option("mode", "DROPMALFORMED").schema(SCHEMA).load(path)
    rows = raw.select("*", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_o", F.monotonically_increasing_id()).where("_lat is not null and _lon is not null")
    rows = checkpointed(rows)
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_block = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_o")) - 1
    rows = rows.withColumn("_in", in_block).join(blocks.withColumn("_before", before), ["file", "_block"])
    idx = F.col("_before") + F.col("_in")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(F.xxhash64("file").alias("drive_id"), idx.cast("long").alias("idx"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), zero("course").alias("course"), zero("speed").alias("speed"), zero("ele").alias("elevation"))


def shift(points: DataFrame, n: int) -> DataFrame:
    """n > 0: the first point n more times in front; n < 0: without the first -n points. idx starts at 0 again."""
    if n < 0:
        return points.where(F.col("idx") >= -n).withColumn("idx", F.col("idx") + n)
    if n == 0:
        return points
    first = points.where("idx = 0").withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return points.withColumn("idx", F.col("idx") + n).unionByName(first.select(*points.columns))


def point_count(points: DataFrame) -> DataFrame:
    return points.groupBy("drive_id").agg(F.count("*").alias("points"))
