"""Nearest words by the join against difflib, distances on the ground, the car's place, steps of the tracker."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom import api
from roadloom.functions import geo
from roadloom.operators import align, fuzzy, tracker
from roadloom.params import DEFAULT


@pytest.mark.parametrize("cutoff", [0.6, 0.8])
def test_nearest_words_same_as_difflib(spark, cutoff):
    r = random.Random(7)
    words = sorted({"".join(r.choice("abceinorst") for _ in range(r.randint(1, 12))) for _ in range(150)})

    def bent(w):
        w = list(w)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "x", "a", "rr"])
        return "".join(w)

    texts = [bent(r.choice(words)) for _ in range(300)] + ["", "Q1 q?", "Минск", words[0].upper() + " 12"]
    df = spark.createDataFrame([(i, t, "w", "t") for i, t in enumerate(texts)] + [(-1, None, "w", "t")], "i int, text string, w string, t string").repartition(4)
    got = {x.i: x.matched for x in fuzzy.fuzzy_match(df, [f" {w.upper()} " for w in words] + [" "], cutoff=cutoff).collect()}
    bare = ["".join(c for c in t.lower() if c.isalpha()) for t in texts]
    want = {i: (difflib.get_close_matches(b, words, n=1, cutoff=cutoff) or [b])[0] for i, b in enumerate(bare)}
    assert got == want | {-1: None}


def test_no_words_match_nothing(spark):
    df = spark.createDataFrame([("Ab1",), (None,)], "text string")
    assert sorted((r.matched or "" for r in fuzzy.fuzzy_match(df, df.select(F.lit("").alias("name"))).collect())) == ["", "ab"]


def test_geodesic_of_arrays_same_as_of_points():
    r = random.Random(3)
    points = [(r.uniform(-89, 89), r.uniform(-180, 180), r.uniform(-89, 89), r.uniform(-180, 180)) for _ in range(300)] + [(5.0, 6.0, 5.0, 6.0), (0.0, 0.0, 0.0, 1.0), (90.0, 0.0, -90.0, 5.0), (53.9, 27.5, 53.9001, 27.5001)]
    got = geo.geodesic_np(*np.array(points).T)
    assert got == pytest.approx([geo.geodesic_m(*p) for p in points], rel=1e-9, abs=1e-6)
    assert np.isnan(geo.geodesic_np(np.array([np.nan]), np.array([1.0]), np.array([2.0]), np.array([3.0]))).all()
    assert len(geo.geodesic_np(*[np.empty(0)] * 4)) == 0


def test_distance_of_projected_points(spark):
    df = spark.createDataFrame([(500_000.0, 5_970_000.0, 500_300.0, 5_970_400.0), (500_000.0, 5_970_000.0, 500_000.0, 5_970_000.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r.m for r in df.select(geo.projected_distance(*[F.col(c) for c in "abcd"]).alias("m")).collect()]
    assert got[0] == pytest.approx(500.2, abs=0.01) and got[1] == 0.0 and got[2] is None


def test_located_takes_the_next_points_course(spark):
    gps = spark.createDataFrame([(1, i, 53.0 + i / 1000, 27.0, 10.0 * i, 5.0, 0.0) for i in range(5)], "drive_id long, idx long, lat double, lon double, course double, speed double, elevation double")
    d = spark.createDataFrame([(1, 1, 7, -1.0), (1, 61, 8, -1.0), (1, 61, 9, -1.0)], "drive_id long, abs_frame long, det_id long, course double")
    got = {r.det_id: r for r in align.located(d, gps).collect()}
    assert {i: (r.gps_index, r.lat, r.course) for i, r in got.items()} == {7: (0, 53.001, 20.0), 8: (1, 53.002, 30.0), 9: (1, 53.002, 30.0)}
    assert got[7].car_e == pytest.approx(500_000.0) and got[7].car_n < got[8].car_n


def det(frame, x=900, y=300, name="a", key=None):
    return {"drive_id": 1, "frame": frame, "det_id": key or frame, "name_sign": name, "number_sign": f"{name}.1", "x": x, "y": y, "w": 40, "h": 40, "is_side": False, "course": 0.0, "car_e": float(frame), "car_n": 0.0, "lat": 53.0, "lon": 27.0, "abs_frame": frame, "text": ""}


def fed(*frames):
    t = tracker.DriveTracker(DEFAULT)
    for dets in frames:
        t.feed(dets[0]["frame"], list(dets))
    return [[r["det_id"] for r in a.rows] for a in t.active]


def test_a_box_that_drops_starts_a_track():
    assert fed([det(1)], [det(2, y=310)]) == [[1, 2]]
    assert fed([det(1)], [det(2, y=311)]) == [[1], [2]]


def test_a_track_waits_for_less_than_seven_frames():
    four = [[det(i)] for i in range(1, 5)]
    assert fed(*four, [det(10)]) == [[1, 2, 3, 4, 10]]
    assert fed(*four, [det(11)]) == [[11]]  # a track of its own; the old one has ended


def test_second_chance_of_a_box_that_moves_alike():
    """The track takes its nearest box; one that dropped is added too, where it lies as far from there as the track had moved, within the slack."""
    assert fed([det(1)], [det(2, x=960, key=2), det(2, x=960, y=340, key=3)]) == [[1, 2, 3]]
    assert fed([det(1)], [det(2, x=960, key=2), det(2, x=960, y=341, key=3)]) == [[1, 2], [3]]
    assert fed([det(1)], [det(2, x=960, key=2), det(2, x=960, y=340, key=3, name="b")]) == [[1, 2], [3]]


def test_what_no_track_takes_starts_one():
    assert fed([det(1)], [det(2, x=900, key=2), det(2, x=1900, y=310, key=3)]) == [[1, 2], [3]]
    assert fed([det(1, x=0)], [det(2, x=851)]) == [[1], [2]]  # 851 - 50 is beyond the reach
    assert fed([det(1, x=0)], [det(2, x=850)]) == [[1, 2]]


def test_jump():
    assert api.jump(90) == 5400
