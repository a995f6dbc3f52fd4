"""Golden vectors of scalar functions."""

import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo, scalars
from roadloom.operators import align, tracks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


L = F.lit


@pytest.mark.parametrize("a,b,want", [((0, 0, 10, 10), (5, 5, 10, 10), 25.0), ((0, 0, 10, 10), (20, 0, 5, 5), 0.0), ((0, 0, 10, 10), (10, 0, 5, 5), 0.0)])
def test_box_overlap(spark, a, b, want):
    assert value(spark, scalars.box_overlap(*map(L, a), *map(L, b))) == want


@pytest.mark.parametrize("lat,lon,e,n", [(45.0, 27.0, 500000.0, 4982950.400), (53.9, 27.5667, 537235.712, 5972544.496)])
def test_utm_and_back(spark, lat, lon, e, n):
    x, y = geo.to_utm(L(lat), L(lon))
    assert value(spark, x) == pytest.approx(e, abs=2e-3)
    assert value(spark, y) == pytest.approx(n, abs=2e-3)
    back = geo.from_utm(x, y)
    assert value(spark, back[0]) == pytest.approx(lat, abs=1e-8)
    assert value(spark, back[1]) == pytest.approx(lon, abs=1e-8)


@pytest.mark.parametrize("azimuth,lat,lon", [(90.0, 53.9, 27.5667763), (0.0, 53.9000450, 27.5667)])
def test_destination(spark, azimuth, lat, lon):
    to = geo.destination(L(53.9), L(27.5667), L(azimuth), 5.0)
    assert (value(spark, to[0]), value(spark, to[1])) == (pytest.approx(lat, abs=1e-7), pytest.approx(lon, abs=1e-7))


def test_bearing_and_haversine(spark):
    assert value(spark, geo.bearing(L(0.0), L(0.0), L(0.0), L(1.0))) == pytest.approx(90.0)
    assert value(spark, geo.bearing(L(53.9), L(27.5), L(53.91), L(27.51))) == pytest.approx(30.499398, abs=1e-5)
    assert value(spark, geo.haversine(L(53.9), L(27.5), L(53.91), L(27.51))) == pytest.approx(1290.565, abs=2e-2)


def test_geodesic_agrees_with_haversine():
    assert geo.geodesic_m(53.9, 27.5, 53.91, 27.51) == pytest.approx(1290.565, rel=4e-3)
    assert geo.geodesic_m(53.9, 27.5, 53.9, 27.5) == 0


@pytest.mark.parametrize("first,last,want", [(350.0, 10.0, 20.0), (10.0, 350.0, -20.0), (0.0, 180.0, 180.0)])
def test_azimuth_change(spark, first, last, want):
    assert value(spark, geo.azimuth_change(L(first), L(last))) == want


def test_lateral_azimuth(spark):
    assert value(spark, geo.lateral_azimuth(L(30.0), L(True))) == 300
    assert value(spark, geo.lateral_azimuth(L(30.0), L(False))) == 120


def test_segment_without_length(spark):
    p = geo.project_on_segment(L(1.0), L(2.0), L(5.0), L(6.0), L(5.0), L(6.0))
    assert (value(spark, p[0]), value(spark, p[1])) == (5.0, 6.0)


@pytest.mark.parametrize("speed,step", [(2, 10), (5, 8), (8, 7), (8.8, 6), (10, 6), (17, 2), (30, 2)])
def test_adaptive_step(spark, speed, step):
    assert value(spark, scalars.adaptive_step(L(float(speed)))) == step


def test_adaptive_step_without_speed(spark):
    assert value(spark, scalars.adaptive_step(L(0.0))) is None
    assert value(spark, scalars.adaptive_step(L(None).cast("double"))) is None


@pytest.mark.parametrize("start,frame,index", [(0, 60, 0), (0, 61, 1), (0, 120, 1), (0, 121, 2), (90, 91, 2), (90, 180, 2), (90, 181, 3)])
def test_gps_index(spark, start, frame, index):
    assert value(spark, align.gps_index(L(frame), start)) == index


def test_text_functions(spark):
    assert value(spark, scalars.ints_in(L("[12, -3, 45]"))) == [12, -3, 45]
    assert tuple(value(spark, scalars.image_id(L("3.24-5-x")))) == ("3.24", "5-x")
    assert value(spark, scalars.time_text(L(3725))) == "1:02"
    assert tuple(value(spark, scalars.video_frame(L(67325)))) == (1, 3725)
    assert value(spark, scalars.floor_div(L(-7), 3)) == -3


def test_confidence(spark):
    pixels = [900, 905, 910, 960, 1010, 1100]
    obs = spark.createDataFrame([(1, x) for x in pixels], "k int, x int")
    steady = tracks.stability(obs, ["k"]).first().stability
    _, placement, total = tracks.confidence(L(4), L(6), L(steady), L(12.0), L(20.0))
    assert steady == pytest.approx(0.519870, abs=1e-6)
    assert value(spark, placement) == pytest.approx(0.478322, abs=1e-6)
    assert value(spark, total) == pytest.approx(0.572494, abs=1e-6)


@pytest.mark.parametrize("score,label", [(0.75, "high"), (0.5, "medium"), (0.3, "low"), (0.29, "very low")])
def test_confidence_label(spark, score, label):
    assert value(spark, tracks.confidence_label(L(score))) == label
