"""Operators on small hand-made tables, with their edge cases."""

import pytest
from pyspark.sql import functions as F

from roadloom.operators import align, clean, dedup, features, fuzzy, lanes, review, tracker, tracks
from roadloom.params import Params


def test_mode_vote_takes_the_first_of_equals(spark):
    obs = spark.createDataFrame([(1, v, i) for i, v in enumerate("babac")], "k int, v string, o int")
    r = tracks.mode_vote(obs, ["k"], "v", "o").first()
    assert (r.best, r.best_count) == ("b", 2)


@pytest.mark.parametrize("votes,want", [([True, False], False), ([True, True, False], True)])
def test_majority(spark, votes, want):
    obs = spark.createDataFrame([(1, v) for v in votes], "k int, is_side boolean")
    assert tracks.observations(obs, ["k"]).first().is_side is want


@pytest.mark.parametrize("xs,want", [([(1500, 40)], False), ([(900, 40), (700, 40)], True), ([(700, 40), (900, 40)], False)])
def test_side_from_motion(spark, xs, want):
    obs = spark.createDataFrame([(1, i, x, w) for i, (x, w) in enumerate(xs)], "k int, o int, x int, w int")
    assert tracks.side_from_motion(obs, ["k"], "o").first().is_left is want


def test_median_box_takes_the_upper_middle(spark):
    obs = spark.createDataFrame([(1, i, 10 * i, i, 5, 6) for i in range(4)], "k int, o int, x int, y int, w int, h int")
    assert tracks.median_box(obs, ["k"], "o").first().mid_x == 20


def test_align_clamps_to_the_last_point(spark):
    gps = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 0.0, 0.0) for i in range(3)], "drive_id long, idx long, lat double, lon double, course double, speed double, elevation double")
    frames = spark.createDataFrame([(1, 60 * i + 1) for i in (0, 1, 2, 9)], "drive_id long, abs_frame long")
    got = {r.abs_frame: r.lat for r in align.align(frames, gps).collect()}
    assert got == {1: 1.0, 61: 2.0, 121: 2.0, 541: 2.0}


def test_align_without_points_gives_zeros(spark):
    gps = spark.createDataFrame([], "drive_id long, idx long, lat double, lon double, course double, speed double, elevation double")
    frames = spark.createDataFrame([(1, 1)], "drive_id long, abs_frame long")
    assert align.align(frames, gps).first().lat == 0.0


def boxes(spark, rows):
    return spark.createDataFrame(rows, "det_id long, drive_id long, frame_number int, name_sign string, x int, y int, w int, h int")


def test_inframe_dedup_is_strict_at_the_limit(spark):
    # exactly 40 % of the first box: both stay
    kept = clean.inframe_dedup(boxes(spark, [(1, 1, 1, "a", 0, 0, 10, 10), (2, 1, 1, "a", 6, 0, 10, 10)]))
    assert kept.count() == 2


def test_inframe_dedup_drops_the_smaller_and_the_later_of_equals(spark):
    rows = [(1, 1, 1, "a", 0, 0, 10, 10), (2, 1, 1, "a", 0, 0, 9, 9), (3, 1, 2, "a", 0, 0, 5, 5), (4, 1, 2, "a", 0, 0, 5, 5), (5, 1, 2, "b", 0, 0, 5, 5)]
    assert sorted(r.det_id for r in clean.inframe_dedup(boxes(spark, rows)).collect()) == [1, 3, 5]


def feature_rows(spark, rows):
    return spark.createDataFrame(rows, "seq long, type string, is_left boolean, e double, n double, azimuth double, length int")


def test_grid_dedup_bounds_are_inclusive(spark):
    both = feature_rows(spark, [(1, "a", True, 0.0, 0.0, 0.0, 3), (2, "a", True, 20.0, 0.0, 30.0, 2)])
    assert [r.seq for r in dedup.grid_dedup(both).collect()] == [1]
    apart = feature_rows(spark, [(1, "a", True, 0.0, 0.0, 0.0, 3), (2, "a", True, 20.0, 0.0, 30.5, 2), (3, "a", False, 0.0, 0.0, 0.0, 1), (4, "b", True, 0.0, 0.0, 0.0, 1)])
    assert sorted(r.seq for r in dedup.grid_dedup(apart).collect()) == [1, 2, 3, 4]


def test_grid_dedup_modes_differ_across_north(spark):
    rows = feature_rows(spark, [(1, "a", True, 0.0, 0.0, 359.0, 3), (2, "a", True, 1.0, 0.0, 1.0, 5)])
    assert [r.seq for r in dedup.grid_dedup(rows).collect()] == [2]
    assert sorted(r.seq for r in dedup.grid_dedup(rows, Params(compat="as_written")).collect()) == [1, 2]


def test_empty_features(spark):
    assert dedup.grid_dedup(feature_rows(spark, [])).count() == 0


def test_expand_lanes_gives_each_type_once(spark):
    t = spark.createDataFrame([(1, "4.1.2-4.1.3-4.1.2", True)], "track_id long, number_sign string, is_left boolean").withColumn("name_sign", F.lit("5.8"))
    got = features.expand_lanes(t).collect()
    assert sorted(r.number_sign for r in got) == ["4.1.2", "4.1.3"]
    assert not any(r.is_left for r in got)


def test_lane_gap(spark):
    rows = spark.createDataFrame([([0, 1, 0, 1],), ([1, 1, 0],), (None,)], "r array<int>")
    assert [r.v for r in rows.select(lanes.has_gap(F.col("r")).alias("v")).collect()] == [True, False, False]


def test_fuzzy_match(spark):
    texts = spark.createDataFrame([("Minsk1",), ("qqqq",), (None,)], "text string")
    assert [r.matched for r in fuzzy.fuzzy_match(texts, ["minsk", "brest"]).collect()] == ["minsk", "qqqq", None]


def drive(spark, rows):
    """Detections (drive, frame, det, class, x, y)."""
    full = [(d, f, i, c, f"{c}.1", x, y, 40, 40, False, 90.0, float(f), 0.0, 53.9, 27.5) for d, f, i, c, x, y in rows]
    return spark.createDataFrame(full, "drive_id long, frame long, det_id long, name_sign string, number_sign string, x int, y int, w int, h int, is_side boolean, course double, car_e double, car_n double, lat double, lon double")


def test_tracker_follows_one_sign(spark):
    got = tracker.track(drive(spark, [(1, f, f, "a", 900 + 10 * f, 300 - f) for f in range(1, 7)])).collect()
    assert [(r.observations, r.mode_count, r.first_frame, r.last_frame) for r in got] == [(6, 6, 1, 6)]


def test_tracker_forgets_short_tracks_and_keeps_active_ones_at_the_end(spark):
    rows = [(1, f, f, "a", 900, 300) for f in (1, 2)] + [(1, f, f, "b", 100, 300) for f in range(30, 36)]
    assert [r.name_sign for r in tracker.track(drive(spark, rows)).collect()] == ["b"]


def test_tracker_of_an_empty_table(spark):
    assert tracker.track(drive(spark, [])).count() == 0


def test_drives_are_apart(spark):
    one = [(1, f, f, "a", 900, 300) for f in range(1, 7)]
    two = one + [(2, f, 100 + f, "a", 900, 300) for f in range(1, 7)]
    assert tracker.track(drive(spark, two)).where("drive_id = 1").drop("drive_id").collect() == tracker.track(drive(spark, one)).drop("drive_id").collect()


@pytest.mark.parametrize("n", [0, 1, 3, 500])
def test_neighbours_across_ranges(spark, n):
    """Ties, and a key that half of the records share; no window puts all records in one task."""
    recs = spark.createDataFrame([(i, None if i % 50 == 9 else 0 if i % 2 else i * 7 % 90) for i in range(n)], "id long, k long").repartition(4)
    got = review.neighbours(recs, ["k"])
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    ids = [r.id for r in sorted(recs.collect(), key=lambda r: (r.k is not None, r.k, r.id))]
    want = {i: (ids[max(j - 1, 0)], ids[min(j + 1, len(ids) - 1)]) for j, i in enumerate(ids)}
    assert {r.id: (r.prev_id, r.next_id) for r in got.collect()} == want
    assert got.count() == n


# -- results that were wrong once


def sighting(frame, x=100, name="a", fine="a.1", east=0.0, det=None):
    return (1, frame, det or frame * 10 + x % 10, name, fine, x, 50, 40, 40, False, 10.0, 5e5 + east, 5.97e6, 53.9, 27.0 + east / 65_000)


def test_a_better_sighting_of_a_sign_replaces_the_known_one(spark):
    """Two tracks of one sign, 5 and 12 votes: the second alone comes out and names the first."""

    rows = [sighting(f) for f in range(1, 6)] + [sighting(f, 101) for f in range(40, 52)]
    d = spark.createDataFrame(rows, "drive_id long, frame long, det_id long, name_sign string, number_sign string, x int, y int, w int, h int, is_side boolean, course double, car_e double, car_n double, lat double, lon double")
    got = tracker.track(d).collect()
    assert [(r.mode_count, r.track_id, r.replaces) for r in got] == [(12, 2, 1)]


@pytest.mark.parametrize("direction,share,gap,want", [("left", 26, False, "4.1.3"), ("right", 25, False, ""), ("back", 0, True, ""), ("back", 50, True, "6.3.1"), ("back", 50, False, ""), ("front", 90, False, "")])
def test_lane_arrows_need_a_quarter_of_their_box(spark, direction, share, gap, want):

    mask = [[1.0] * share + [0.0] * (100 - share)]
    row = [1.0, 0.0, 1.0] if gap else [1.0, 1.0, 0.0]
    d = spark.createDataFrame([(1, 1, direction, mask, 100, 1, row)], "sign int, seq int, direction string, mask array<array<double>>, w int, h int, centre_row array<double>")
    assert lanes.lane_types(d, ["sign"]).first().lane_type == want


def test_arrow_masks(spark):

    masks = [[[0.0, 1.0, 1.0], [0.0, 1.0, 0.0]], [[0.0] * 3] * 2]
    d = spark.createDataFrame([(1, masks, [(1, 0, 3, 2, "left"), (0, 0, 1, 1, "right")])], "sign int, masks array<array<array<double>>>, boxes array<struct<x1:int,y1:int,x2:int,y2:int,direction:string>>")
    made = lanes.arrow_masks(d, ["sign"])
    assert [(r.direction, r.mask) for r in made.orderBy("seq").collect()][:2] == [("left", [[1.0, 1.0], [1.0, 0.0]]), ("right", [[0.0]])]
    assert lanes.lane_types(made, ["sign"]).first().lane_type == "4.1.3"


@pytest.mark.parametrize("length,frames,want", [("0", "[1, 2]", 0.0), ("", "[1, 2]", 1.0), (None, "[1, 2]", 1.0), ("1", "[1, 2]", 0.5), ("9", "[1, 2]", 1.0), ("3", "[]", 0.0), ("x", "[1]", 0.0)])
def test_review_confidence(spark, length, frames, want):

    d = spark.createDataFrame([("i", "1.1", length, "True", *[frames] * 6)], "id string, type string, length string, left string, frame_numbers string, absolute_frame_numbers string, pixel_coordinates_x string, pixel_coordinates_y string, w string, h string")
    assert review.records(d).first().confidence == want


def test_tracks_and_turns(spark):
    """Each track once: with the turn it meets, in front of its end on the turn, else straight at its last point."""

    t = spark.createDataFrame([(1, 1, 9, 10, 15, 0.0, 0.0, 1.0, 1.0), (1, 2, 9, 10, 30, 0.0, 0.0, 1.0, 1.0), (1, 3, 3, 41, 44, 0.0, 0.0, 1.0, 1.0), (2, 1, 9, 1, 9, 5.0, 6.0, 1.0, 1.0)], "drive_id long, track_id long, mode_count int, first_frame long, last_frame long, car_e double, car_n double, lat double, lon double")
    turns = spark.createDataFrame([(1, 1, [9, 20], [(45.0, 27.0), (45.0, 27.0)]), (1, 2, [40, 50], [(45.0, 27.0)])], "drive_id long, turn_id long, frames array<long>, coordinates array<struct<lat:double,lon:double>>")
    straight, turn = tracks.split_on_turn(t, turns)
    assert [(r.track_id, r.turn_id) for r in turn.collect()] == [(1, 1)]
    got = {(r.drive_id, r.track_id): (r.turn_id, round(r.car_e, 3), round(r.car_n, 3)) for r in straight.collect()}
    assert got == {(1, 2): (1, 500000.0, 4982950.4), (1, 3): (2, 500000.0, 4982950.4), (2, 1): (None, 5.0, 6.0)}


def test_edits_keep_what_they_dont_say(spark):

    f = spark.createDataFrame([(i, "3.24", 10320, "60", "60") for i in range(5)], "id long, type string, code long, SEM250 string, MVALUE string")
    e = spark.createDataFrame([(0, None, "70", None, 1), (1, "2.1", "x", False, 1), (1, "3.24", "80", False, 2), (2, "2.1", None, False, 1), (2, "2.1", None, True, 0), (9, "2.1", None, False, 1)], "id long, new_type string, new_text string, deleted boolean, seq int")
    codes = spark.createDataFrame([("3.24", "10320"), ("2.1", "10211")], "type string, code string")
    got = {r.id: (r.type, r.code, r.SEM250) for r in review.apply_edits(f, e, codes).collect()}
    assert got == {0: ("3.24", 10320, "70"), 1: ("3.24", 10320, "80"), 3: ("3.24", 10320, "60"), 4: ("3.24", 10320, "60")}


def test_confident_boxes_lie_in_the_frame(spark):

    d = spark.createDataFrame([(1, -50, 10, 40, 40), (2, -10, 10, 40, 40), (3, 1920, 10, 40, 40), (4, 10, 1079, 40, 40), (5, 10, 10, 0, 40)], "det_id int, x int, y int, w int, h int").selectExpr("*", "0.9 as box_confidence", "0.9 as coarse_confidence")
    assert sorted(r.det_id for r in clean.confident(d).collect()) == [2, 4]


def test_turn_features(spark):
    """Signs of a turn lie off its anchors, one slot after the other; lane signs go."""
    from roadloom.operators import features, turns

    t = turns.anchors(spark.createDataFrame([(1, 1, [(53.9, 27.5), (53.91, 27.51)], [0.0, 90.0])], "drive_id long, turn_id long, coordinates array<struct<lat:double,lon:double>>, azimuths array<double>"))
    s = spark.createDataFrame([(1, 1, i, "5", name, False, False) for i, name in enumerate(("a", "b", "5.8"))], "drive_id long, turn_id long, track_id long, number string, name_sign string, is_side boolean, is_left boolean")
    made = features.turn_lines(features.turn_slots(s, ["track_id"]), t).orderBy("track_id").collect()
    assert [(r.track_id, r.slot, r.azimuth) for r in made] == [(0, 2, 0.0), (1, 3, 0.0)]
    assert all(abs(r.lat1 - 53.9) < 1e-3 and (r.lat1, r.lon1) != (r.lat2, r.lon2) for r in made) and made[0].lat1 != made[1].lat1
