"""From detections to the stored layer and back, and road cells."""

import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.operators import layer, review, snap, tracker, tracks
from roadloom.params import DEFAULT
from roadloom.sources import geojson

TURNING = replace(DEFAULT, turn_change=10.0)
SCHEMA = "drive_id long, frame long, det_id long, name_sign string, number_sign string, x int, y int, w int, h int, is_side boolean, course double, car_e double, car_n double, lat double, lon double, abs_frame long, text string"


def drive(spark):
    """A road with a sign, then a bend with one that is seen before its end, then a sign with text twice in one place."""
    rows = []

    def add(frames, name, number, x, course, metres=10.0, text=None):
        for f in frames:
            rows.append((1, f, 10 * f + x % 7, name, number, x, 300, 40, 40, f % 3 == 0, course(f), 500_000.0 + metres * f, 5_970_000.0, 0.0, 0.0, 63_600 + f, text))

    add(range(1, 9), "krug", "3.1", 900, lambda f: 90.0)
    add(range(20, 30), "krug", "3.2", 400, lambda f: 90.0 if f < 25 else (90.0 + 20 * (f - 24)) % 360)
    add(range(30, 34), "krug", "9.99", 1500, lambda f: (90.0 + 20 * (f - 24)) % 360)
    add(range(34, 50), "plain", "2.1", 200, lambda f: 280.0)
    add(range(60, 70), "krug", "3.24", 700, lambda f: 270.0, text="60")
    add(range(80, 92), "krug", "3.24", 700, lambda f: 270.0, metres=0.0, text="70")
    df = spark.createDataFrame(rows, SCHEMA)
    lat, lon = geo.from_utm(F.col("car_e"), F.col("car_n"))
    return df.withColumns({"lat": lat, "lon": lon})


@pytest.fixture(scope="module")
def made(spark):
    segs = snap.segments(spark.createDataFrame([(7, "road", [(53.8, 26.99), (53.8, 27.0)])], "way_id long, name string, nodes array<struct<lat:double,lon:double>>"))
    videos = spark.createDataFrame([(0, "a.mp4"), (1, "b.mp4")], "video long, name_video string")
    return layer.sign_layer(drive(spark), segs, videos, params=TURNING)


def test_layer_has_all_properties(spark, made):
    rows = {r.properties.type: r.properties for r in made.collect() if r.properties.type != "3.24"}
    p = rows["3.1"].asDict()
    assert sorted(p) == sorted(f.name for f in geojson.empty_features(spark).schema["properties"].dataType)
    assert (p["length"], p["turn"], p["left"], p["name_video"], p["time"], p["MVALUE"]) == ("8", "straight", "False", "b.mp4", "0:00", None)
    assert p["side"] == "[False, False, True, False, False, True, False, False]" and p["frame_numbers"] == "[1, 2, 3, 4, 5, 6, 7, 8]" and p["absolute_frame_numbers"].startswith("[63601, ")
    assert p["num"] == "63608" and p["pixel_coordinates_x"] == str([900] * 8) and p["w"] == p["h"] == str([40] * 8) and p["car_coordinates_x"].startswith("[500010.0, 500020.0")
    assert rows["3.2"]["turn"] == "right" and "9.99" not in rows
    texts = sorted((r.properties.SEM250, r.properties.MVALUE) for r in made.collect() if r.properties.type == "3.24")
    assert texts == [("60", "60"), ("70", "70")]


def test_layer_round_trip_and_review(spark, made, tmp_path):
    geojson.write_geojson(made, str(tmp_path / "signs"))
    again = geojson.read_geojson(spark, str(tmp_path / "signs"))
    back = lambda df: sorted(json.dumps(r.properties.asDict(), sort_keys=True) for r in df.select("properties").collect())
    assert back(again) == back(made)
    records = review.records(geojson.flat(again)).collect()
    assert len(records) == made.count() and all(r.confidence > 0 for r in records)


def test_turn_signs_lie_off_the_turn(spark, made):
    r = next(r for r in made.collect() if r.properties.turn == "right")
    turn = tracker.tracks_and_turns(drive(spark), TURNING).where("kind = 'turn'").first()
    (lon1, lat1), _ = r.geometry.coordinates
    at = turn.coordinates[0]
    assert math.hypot((lat1 - at.lat) * 111_320, (lon1 - at.lon) * 111_320 * math.cos(math.radians(at.lat))) < 60
    assert r.properties.azimuth in {str(turn.azimuths[0]), str(turn.azimuths[-1])}


def test_commonest_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, ["b", "a", "a", "b"]), (2, []), (3, None), (4, ["x"])], "k int, v array<string>")
    assert {r.k: r.c for r in df.select("k", layer.commonest("v").alias("c")).collect()} == {1: "b", 2: None, 3: None, 4: "x"}


def segs_of(spark, rows):
    return spark.createDataFrame([(i, 0, "r", *r) for i, r in enumerate(rows)], "way_id long, seg int, name string, lat1 double, lon1 double, lat2 double, lon2 double")


def test_road_cells_grow_with_the_length(spark):
    cells = lambda d: snap.road_cells(segs_of(spark, [(53.0, 27.0, 53.0 + d, 27.0 + d)]), 30.0).count()
    assert 1.9 < cells(0.4) / cells(0.2) < 2.1
    flat = snap.road_cells(segs_of(spark, [(53.0, 27.0, 53.0, 27.2), (53.0, 27.0, 53.2, 27.0)]), 30.0).groupBy("way_id").count()
    assert all(200 < r["count"] < 700 for r in flat.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_snap_same_as_all_pairs(spark, seed):
    r = random.Random(seed)
    at = lambda: (53.0 + r.uniform(0, 0.02), 27.0 + r.uniform(0, 0.02))
    roads = [(*at(), *at()) for _ in range(40)] + [(53.0, 27.0, 53.0, 27.02), (53.01, 27.0, 53.02, 27.0), (53.005, 27.005, 53.005, 27.005)]
    segs = segs_of(spark, roads)
    points = spark.createDataFrame([(i, *at()) for i in range(400)], "point_id long, lat double, lon double")
    lat, lon = geo.project_on_segment(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")])
    far = points.crossJoin(segs).withColumns({"a": lat, "b": lon}).withColumn("distance", geo.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).where("distance <= 30")
    want = far.groupBy("point_id").agg(F.min(F.struct("distance", "way_id")).alias("m")).select("point_id", F.col("m.way_id").alias("way"))
    got = snap.snap(points, segs).where("snapped").select("point_id", F.col("road_way_id").alias("way"))
    pairs = lambda df: sorted((x.point_id, x.way) for x in df.collect())
    assert pairs(got) == pairs(want) and pairs(want)


def test_directions_of_turns_and_their_sixty_degrees(spark):
    """The reversed start lies 60 degrees to the side that the drive turns to, the reversed end 30."""
    df = spark.createDataFrame([(1, 350.0, 20.0), (2, 20.0, 350.0), (3, 90.0, 90.0), (4, 0.0, 180.0)], "k int, a double, b double")
    t = df.select("k", "a", geo.turn_anchors(F.lit(53.0), F.lit(27.0), F.lit(53.1), F.lit(27.1), F.col("a"), F.col("b")).alias("t"))
    got = {}
    for r in t.select("k", "a", *[F.round(geo.bearing(F.lit(53.0), F.lit(27.0), F.col(f"t.{c}.lat"), F.col(f"t.{c}.lon")), 3).alias(c) for c in ("rev_start", "rev_end")]).collect():
        got[r.k] = ((r.rev_start - r.a) % 360, (r.rev_end - r.a) % 360)
    assert {k: (round(a), round(b)) for k, (a, b) in got.items()} == {1: (60, 30), 2: (300, 330), 3: (60, 30), 4: (60, 30)}


def test_merged_tracks_hold_both(spark):
    a = spark.createDataFrame([(1, [1, 2], ["x"]), (2, [5], [])], "k int, xs array<int>, texts array<string>")
    b = spark.createDataFrame([(1, [3], ["y", "z"]), (9, [9], [])], "k int, xs array<int>, texts array<string>")
    assert sorted((r.k, r.xs, r.texts) for r in tracks.merge_tracks(a, b, ["k"]).collect()) == [(1, [1, 2, 3], ["x", "y", "z"]), (2, [5], [])]


def test_export_writes_one_collection_and_refuses_an_empty_layer(spark, made, tmp_path):
    from roadloom import api

    with pytest.raises(FileNotFoundError):
        api.export(geojson.empty_features(spark), str(tmp_path / "none"))
    path = api.export(made, str(tmp_path / "out"))
    files = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
    assert path == str(tmp_path / "out") and len(files) == 1
    assert len(json.loads(files[0].read_text())["features"]) == made.count()
    api.export(made.limit(1), path)  # what is there is replaced
    assert geojson.read_geojson(spark, path).count() == 1


def test_layers_are_saved_whole(spark, made, tmp_path):
    from roadloom.sources import layers

    segs = snap.segments(spark.createDataFrame([(7, "road", [(53.8, 26.99), (53.8, 27.0)])], "way_id long, name string, nodes array<struct<lat:double,lon:double>>"))
    videos = spark.createDataFrame([(0, "a.mp4"), (1, "b.mp4")], "video long, name_video string")
    layer.save(drive(spark), segs, videos, str(tmp_path / "l"), params=TURNING)
    assert sorted(map(str, layers.read_layer(spark, str(tmp_path / "l")).collect())) == sorted(map(str, made.collect()))


def test_unknown_types_and_signs_without_a_road_or_video(spark):
    """Types that no code names go; without roads the car's azimuth stays; frames beyond the videos are of an unknown one."""
    segs = snap.segments(spark.createDataFrame([], "way_id long, name string, nodes array<struct<lat:double,lon:double>>"))
    videos = spark.createDataFrame([], "video long, name_video string")
    codes = spark.createDataFrame([("3.1", "5")], "type string, code string")
    rows = layer.sign_layer(drive(spark), segs, videos, codes, TURNING).collect()
    assert [(r.properties.type, r.properties.code, r.properties.azimuth, r.properties.name_video) for r in rows] == [("3.1", 5, "90.0", "unknown")]
    assert layer.sign_layer(drive(spark).limit(0), segs, videos, codes, TURNING).count() == 0
