"""Snapping of points to roads."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import DEGREE_M, bearing, haversine, project_on_segment
from roadloom.params import DEFAULT, Params
from roadloom.tables import checkpointed

# Road classes that signs may stand on.
HIGHWAYS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "living_street", "motorway_link", "trunk_link", "primary_link", "secondary_link")


def segments(ways: DataFrame) -> DataFrame:
    """Pairs of consecutive nodes: way_id, seg, name, lat1, lon1, lat2, lon2."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct((i - 1).alias("seg"), F.element_at("nodes", i).alias("a"), F.element_at("nodes", i + 1).alias("b")))
    return ways.where(F.size("nodes") >= 2).select("way_id", "name", F.explode(pairs).alias("p")).select("way_id", "p.seg", "name", F.col("p.a.lat").alias("lat1"), F.col("p.a.lon").alias("lon1"), F.col("p.b.lat").alias("lat2"), F.col("p.b.lon").alias("lon2"))


#: Shares of a radius that are looked into one after the other, if they are metres enough.
RINGS, LEAST_RING = (1 / 16, 1 / 4, 1), 7.0
#: Metres of a degree, a little fewer than on the sphere, so that what is within a reach is in it.
_LEAST_DEGREE_M = 111_000.0


def _size(radius: float) -> float:
    """Degrees of a cell's side."""
    return max(2 * radius, 100.0) / DEGREE_M


def road_cells(segs: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """segs in every cell (r, c) within the radius: those along the line, row by row, not all of its box.

    In each row of cells a segment keeps the stretch that the row, grown by the radius, cuts out; its columns are those of
    this stretch, grown in turn. So a segment has as many cells as it is long.
    """
    size, reach = size or _size(radius), radius / _LEAST_DEGREE_M
    at = lambda c: F.floor(c / size).cast("long")
    highest = F.greatest(F.abs("lat1"), F.abs("lat2"))
    wide = reach / F.greatest(F.cos(F.radians(highest + reach)), F.lit(0.01))
    rows = segs.withColumn("r", F.explode(F.sequence(at(F.least("lat1", "lat2") - reach), at(F.greatest("lat1", "lat2") + reach))))
    rise = F.col("lat2") - F.col("lat1")
    # how far along the segment the row's edges are, from 0 to 1
    share = lambda lat, level: F.when(rise == 0, level).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - F.col("lat1")) / rise)))
    low, high = share(F.col("r") * size - reach, 0.0), share((F.col("r") + 1) * size + reach, 1.0)
    cut = rows.withColumns({"_t0": F.least(low, high), "_t1": F.greatest(low, high)})
    lon = lambda t: F.col("lon1") + F.col(t) * (F.col("lon2") - F.col("lon1"))
    ends = cut.withColumns({"_a": F.least(lon("_t0"), lon("_t1")) - wide, "_b": F.greatest(lon("_t0"), lon("_t1")) + wide})
    return ends.withColumn("c", F.explode(F.sequence(at(F.col("_a")), at(F.col("_b"))))).drop("_t0", "_t1", "_a", "_b")


def snap(points: DataFrame, segs: DataFrame, params: Params = DEFAULT, radius_m: float | None = None) -> DataFrame:
    """points (point_id, lat, lon) with the nearest segment within the radius: equi-joins on grid cells.

    A segment is listed in every cell along it within the radius; a point looks into its own cell alone. The radius
    grows by RINGS, and only points that found nothing yet look further: what is nearest within a smaller radius is
    nearest of all, so among many roads a point meets few. Ties go to the smaller way, then segment. Points without a
    road in reach keep nulls.
    """
    radius = params.snap_radius_m if radius_m is None else radius_m
    waiting, found = checkpointed(points.select("lat", "lon").distinct()), []  # points of one place have one road
    for ring in [radius * share for share in RINGS if share == 1 or radius * share >= LEAST_RING]:
        found.append(checkpointed(_nearest(waiting, segs, ring)))
        if ring < radius:
            waiting = checkpointed(waiting.join(found[-1], ["lat", "lon"], "left_anti"))
            if waiting.isEmpty():
                break
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)
    best = best.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "s")
    return points.join(best, (points.lat == F.col("_lat")) & (points.lon == F.col("_lon")), "left").select(points["*"], F.col("s").isNotNull().alias("snapped"), *[F.col(f"s.{c}").alias(f"road_{c}") for c in ("way_id", "seg", "name", "snap_lat", "snap_lon", "azimuth", "distance")])


def _nearest(places: DataFrame, segs: DataFrame, radius: float) -> DataFrame:
    """lat, lon and s, the nearest segment, of places that have one within the radius."""
    ends = ["lat1", "lon1", "lat2", "lon2"]
    size, tasks = 2 * radius / DEGREE_M, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = places.withColumns({"r": F.floor(F.col("lat") / size).cast("long"), "c": F.floor(F.col("lon") / size).cast("long")})
    # numbers of tasks: small as both inputs are, their cells and pairs are many
    met = at.repartition(tasks, "r", "c").join(road_cells(segs.repartition(tasks, "way_id", "seg"), radius, size), ["r", "c"])
    plat, plon = project_on_segment(*[F.col(c) for c in ("lat", "lon", *ends)])
    near = met.withColumn("snap_lat", plat).withColumn("snap_lon", plon).withColumn("distance", haversine(F.col("lat"), F.col("lon"), F.col("snap_lat"), F.col("snap_lon"))).where(F.col("distance") <= radius)
    near = near.withColumn("azimuth", bearing(*[F.col(c) for c in ends]))
    return near.groupBy("lat", "lon").agg(F.min_by(F.struct("way_id", "seg", "name", "snap_lat", "snap_lon", "azimuth", "distance"), F.struct("distance", "way_id", "seg")).alias("s"))


def degrees_reach(metres: float, lat: float) -> float:
    """Degrees of longitude that metres span at a latitude."""
    return metres / (DEGREE_M * math.cos(math.radians(lat)))
