"""Readers and writers, round trips and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from roadloom import api
from roadloom.operators import tracker
from roadloom.sources import geojson, gpx, roads
from roadloom.streaming.tracking import track_stream

GPX = '<?xml version="1.0"?><gpx version="1.1"><metadata/><extra/><trk><trkseg>{}</trkseg></trk></gpx>'
POINT = '<trkpt lat="{}" lon="{}"><ele>1.5</ele><course>90</course><speed>3</speed></trkpt>'


@pytest.fixture
def track_file(tmp_path):
    p = tmp_path / "a.gpx"
    p.write_text(GPX.format("".join(POINT.format(50 + i, 27) for i in range(3)) + '<trkpt lat="60" lon="27"></trkpt>'))
    return str(p)


def test_gpx(spark, track_file):
    got = gpx.read_gpx(spark, track_file).orderBy("idx").collect()
    assert [(r.idx, r.lat, r.course, r.speed) for r in got] == [(0, 50, 90, 3), (1, 51, 90, 3), (2, 52, 90, 3), (3, 60, 0, 0)]
    assert [r.point for r in api.track(gpx.read_gpx(spark, track_file)).collect()][0] == [50, 27]


@pytest.mark.parametrize("n,want", [(2, [50, 50, 50, 51, 52, 60]), (-2, [52, 60]), (0, [50, 51, 52, 60]), (-9, [])])
def test_gpx_shift(spark, track_file, n, want):
    got = gpx.shift(gpx.read_gpx(spark, track_file), n).orderBy("idx").collect()
    assert [r.lat for r in got] == want
    assert [r.idx for r in got] == list(range(len(want)))


def test_empty_gpx(spark, tmp_path):
    p = tmp_path / "e.gpx"
    p.write_text(GPX.format(""))
    assert gpx.read_gpx(spark, str(p)).count() == 0


def collection(tmp_path, features):
    p = tmp_path / "f.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(p)


def feature(i, coordinates=((27.0, 53.0), (27.1, 53.1)), **props):
    return {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [list(c) for c in coordinates]}, "properties": {"id": str(i), "type": "1.1", "code": 7, "left": "True", **props}}


def test_geojson_round_trip(spark, tmp_path):
    read = geojson.read_geojson(spark, collection(tmp_path, [feature(1), feature(2, SEM250="x")]))
    geojson.write_geojson(read, str(tmp_path / "out"))
    again = geojson.read_geojson(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.drop("seq").collect())) == sorted(map(str, read.drop("seq").collect()))


def test_empty_geojson(spark, tmp_path):
    assert geojson.read_geojson(spark, collection(tmp_path, [])).count() == 0
    geojson.write_geojson(geojson.empty_features(spark), str(tmp_path / "none"))
    assert geojson.read_geojson(spark, str(tmp_path / "none")).count() == 0


def test_signs_skip_features_without_coordinates(spark, tmp_path):
    f = geojson.read_geojson(spark, collection(tmp_path, [feature(1), feature(2, coordinates=()), feature("")]))
    got = api.signs(f).collect()
    assert len(got) == 2 and got[0].id == "1" and len(got[1].id) == 32
    assert api.map_filter(api.signs(f), "1.1", "left").count() == 2
    assert api.map_filter(api.signs(f), "1.1", "right").count() == 0
    assert api.sign(f, "1").count() == 1 and api.sign(f, "missing").count() == 0


def test_update_and_delete(spark, tmp_path):
    flat = geojson.flat(geojson.read_geojson(spark, collection(tmp_path, [feature(1, SEM250="old"), feature(2)])))
    done = {r.id: r for r in api.update(flat, "1", new_type="no such type").collect()}
    assert done["1"].type == "no such type" and done["1"].code == 7 and done["1"].SEM250 is None and done["2"].type == "1.1"
    assert api.delete(flat, spark.createDataFrame([("1",), ("9",)], "id string")).count() == 1
    assert api.sign_types(spark).count() == 127


def test_roads(spark, tmp_path):
    node = {"lat": 1.0, "lon": 2.0}
    way = lambda i, n, tags: {"type": "way", "id": i, "geometry": [node] * n, "tags": tags}
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"elements": [way(1, 2, {"highway": "primary", "name": "x"}), way(2, 1, {"highway": "primary"}), way(3, 2, {"highway": "footway"}), {"type": "node", "id": 4}]}))
    assert sorted((r.way_id, r.name) for r in roads.read_roads(spark, str(p)).collect()) == [(1, "x"), (3, "")]
    assert [r.way_id for r in roads.read_roads(spark, str(p), ("primary",)).collect()] == [1]


def test_videos_and_cities(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for n in ("b.MP4", "a.mp4", "c.txt"):
        (tmp_path / "v" / n).write_bytes(b"12")
    assert [(r.video, r.name_video, r.bytes) for r in roads.list_videos(spark, str(tmp_path / "v")).orderBy("video").collect()] == [(0, "a.mp4", 2), (1, "b.MP4", 2)]
    (tmp_path / "c").write_text(" Minsk \n\nBrest\n")
    assert sorted(r.name for r in roads.read_cities(spark, str(tmp_path / "c")).collect()) == ["brest", "minsk"]


def test_stream_gives_the_batch_tracks(spark, tmp_path):
    """Files of one drive, in order; all tracks that end before the stream does."""
    schema = "drive_id long, frame long, det_id long, name_sign string, number_sign string, x int, y int, w int, h int, is_side boolean, course double, car_e double, car_n double, lat double, lon double"
    rows = [(1, f, f, "a", "a.1", 900, 300, 40, 40, False, 90.0, float(f), 0.0, 53.9, 27.5) for f in range(1, 7)] + [(1, f, f, "b", "b.1", 100, 300, 40, 40, False, 90.0, float(f), 0.0, 54.9, 27.5) for f in range(40, 80)]
    table = spark.createDataFrame(rows, schema)
    for k, (low, high) in enumerate(((1, 4), (4, 50), (50, 80))):
        table.where((F.col("frame") >= low) & (F.col("frame") < high)).coalesce(1).write.json(str(tmp_path / f"in{k}"))
    (tmp_path / "all").mkdir()
    import os
    import shutil
    import time

    for k in range(3):
        part = next((tmp_path / f"in{k}").glob("*.json"))
        shutil.copy(part, tmp_path / "all" / f"{k}.json")
        os.utime(tmp_path / "all" / f"{k}.json", (time.time() + k, time.time() + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "all"))
    q = track_stream(stream).writeStream.format("memory").queryName("tracks_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    ended = spark.table("tracks_out").where("name_sign = 'a'").select("observations", "first_frame", "last_frame").collect()
    batch = tracker.track(table).where("name_sign = 'a'").select("observations", "first_frame", "last_frame").collect()
    assert ended == batch and len(batch) == 1
