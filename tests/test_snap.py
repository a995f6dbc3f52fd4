"""Snapping among crowds of roads and at the edge of the radius, against all pairs."""

import math
import random

from roadloom.functions.geo import DEGREE_M, EARTH_M
from roadloom.operators import snap

SEGS = "way_id long, seg int, name string, lat1 double, lon1 double, lat2 double, lon2 double"


def nearest(point, segs, radius):
    """way_id and seg of the nearest segment within the radius, by all pairs."""
    lat, lon = point
    kx, best = math.cos(math.radians(lat)) * DEGREE_M, None
    for way, seg, _, a, b, c, d in segs:
        dx, dy, px, py = (d - b) * kx, (c - a) * DEGREE_M, (lon - b) * kx, (lat - a) * DEGREE_M
        t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        p, q, w = math.radians(lat), math.radians(a + t * (c - a)), math.radians(b + t * (d - b) - lon)
        m = 2 * EARTH_M * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(w / 2) ** 2))
        if m <= radius and (best is None or (m, way, seg) < best):
            best = m, way, seg
    return best and best[1:]


def test_what_is_just_within_the_radius_is_found_across_cells(spark):
    edge = 12_000 * 500 / DEGREE_M  # of cells for 250 m
    rows = [(1, 0, "a", edge - 0.002247, 27.0, edge - 0.002247, 27.0)]
    points = spark.createDataFrame([(1, edge + 0.0000005, 27.0)], "point_id long, lat double, lon double")
    got = snap.snap(points, spark.createDataFrame(rows, SEGS), radius_m=250.0).first()
    assert got.snapped and 249.8 < got.road_distance <= 250


def test_rings_give_the_nearest_of_all_pairs(spark):
    r = random.Random(3)
    segs = []
    for i in range(300):  # crowds in the west, few roads in the east
        lat, lon = 53.8 + r.random() / 100, 27.4 + (r.random() / 200 if i < 270 else r.random() / 20)
        segs.append((i // 3, i % 3, "a", lat, lon, lat + r.choice([0, r.uniform(-3, 3) / 1e3]), lon + r.choice([0, r.uniform(-3, 3) / 1e3])))
    segs += [(900 + s[0], *s[1:]) for s in segs[:50]]  # ties
    places = [(53.8 + r.random() / 100, 27.4 + r.random() / 20) for _ in range(200)] + [(s[3], s[4]) for s in segs[:20]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places + places[:30])] + [(999, None, 27.4)], "point_id long, lat double, lon double")
    got = {x.point_id: (x.road_way_id, x.road_seg) if x.snapped else None for x in snap.snap(points, spark.createDataFrame(segs, SEGS), radius_m=250.0).collect()}
    assert got == {i: nearest(p, segs, 250.0) for i, p in enumerate(places + places[:30])} | {999: None}
