"""Turns as state of the tracker, known signs by cell, and the same over a stream."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from roadloom.functions.geo import geodesic_m
from roadloom.operators import tracker
from roadloom.params import DEFAULT, Params
from roadloom.streaming.tracking import track_stream

SCHEMA = "drive_id long, frame long, det_id long, name_sign string, number_sign string, x int, y int, w int, h int, is_side boolean, course double, car_e double, car_n double, lat double, lon double, abs_frame long, text string, ts timestamp"
TURNING = replace(DEFAULT, turn_change=10.0)


def det(frame, course, name="a", x=900, y=300, drive=1, e=None, **more):
    e = float(frame) if e is None else e
    row = {"drive_id": drive, "frame": frame, "det_id": frame, "name_sign": name, "number_sign": f"{name}.1", "x": x, "y": y, "w": 40, "h": 40, "is_side": False, "course": course, "car_e": e, "car_n": 2 * e, "lat": 53.0 + e / 1000, "lon": 27.0, "abs_frame": 100 + frame, "text": None}
    return row | more


def run(rows, params=TURNING):
    t = tracker.DriveTracker(params)
    out = []
    for frame in sorted({r["frame"] for r in rows}):
        out += t.feed(frame, [r for r in rows if r["frame"] == frame])
    return t, out + t.flush()


def test_a_sign_seen_in_a_turn_leaves_with_it():
    rows = [det(f, 0.0) for f in range(1, 9)] + [det(9, 30.0), det(10, 60.0)] + [det(f, 60.0 + 30 * (f - 10), name="b", x=100) for f in (11, 12)] + [det(f, 120.0, name="b", x=100) for f in (13, 14)]
    _, out = run(rows)
    turn, sign = out[0], out[1]
    assert isinstance(turn, tracker.Turn) and (turn.frames, turn.azimuths, turn.direction) == ([9, 10, 11, 12], [30.0, 60.0, 90.0, 120.0], "right")
    assert turn.points[0][:2] == (9.0, 18.0)
    assert (sign.turn_id, sign.direction, sign.place, sign.votes) == (1, "right", "5", 10)


def test_a_sign_seen_to_the_end_of_the_turn_takes_its_points():
    rows = [det(f, 0.0) for f in range(1, 9)] + [det(9, -30.0 % 360), det(10, 300.0)] + [det(f, 300.0) for f in (11, 12)]
    t, out = run(rows)
    turn, sign = out
    assert turn.direction == "left" and sign.turn_id is None
    assert [c[0] for c in sign.cars] == [9.0, 10.0, 11.0, 12.0]  # the turn's points, then new ones


def test_turns_without_tracks_or_of_one_point_are_none():
    one = [det(f, 0.0 if f < 5 else 30.0) for f in range(1, 10)]
    assert [type(x) for x in run(one)[1]] == [tracker.Track]
    alone = [det(1, 0.0), det(2, 30.0), det(3, 60.0), det(4, 60.0)]
    assert [type(x) for x in run(alone, replace(TURNING, compat="as_written"))[1]] == [tracker.Turn]
    assert [x for x in run([det(1, None), det(2, 40.0), det(3, 41.0)])[1] if isinstance(x, tracker.Turn)] == []


def test_nothing_ends_while_a_turn_holds_tracks():
    rows = [det(f, 0.0) for f in range(1, 6)] + [det(f, 30.0 * (f - 4) % 360, name="b", x=100, y=100) for f in range(5, 17)]
    plain, turning = run(rows, DEFAULT)[1], run(rows)[1]
    assert [x.rows[-1]["frame"] for x in plain if x.best(x.coarse) == "a"] == [5] and isinstance(turning[0], tracker.Turn)
    assert run(rows[:-4], replace(TURNING, compat="as_written"))[1] == []  # still turning


def test_a_turn_open_at_the_end_closes_there():
    rows = [det(f, 0.0) for f in range(1, 8)] + [det(8, 40.0), det(9, 80.0)]
    assert isinstance(run(rows)[1][0], tracker.Turn)


def linear(known, kind, left, lat, lon, radius):
    return next((s for k, side, s in known if k == kind and side == left and geodesic_m(s["lat"], s["lon"], lat, lon) < radius), None)


@pytest.mark.parametrize("lat0,lon0", [(53.9, 27.5), (0.0, 179.99999), (89.9999, 10.0), (-33.0, -70.0)])
def test_known_signs_by_cell_same_as_a_scan(lat0, lon0):
    r = random.Random(5)
    cells, scan = tracker.KnownSigns(8.0), []
    hits = 0
    for i in range(600):
        lat, lon = lat0 + r.uniform(-2e-4, 2e-4), lon0 + r.uniform(-2e-4, 2e-4)
        lon = lon - 360 if lon > 180 else lon
        lat = min(lat, 180 - lat)
        kind, left = r.choice("ab"), r.random() < 0.5
        a, b = cells.near(kind, left, lat, lon), linear(scan, kind, left, lat, lon, 8.0)
        assert (a and a["number"]) == (b and b["number"])
        hits += a is not None
        if b is not None and r.random() < 0.5:
            scan.remove(next(x for x in scan if x[2] is b))
            cells.drop(kind, left, a)
        cells.add(kind, left, lat, lon, 1, i)
        scan.append((kind, left, {"lat": lat, "lon": lon, "number": i}))
    assert hits > 50


def drives(seed=2, n=4, frames=90):
    """Random drives: signs that come nearer, a course that bends at times, places that come again."""
    r = random.Random(seed)
    rows = []
    for drive in range(1, n + 1):
        course, signs, key = 0.0, [], 0
        for f in range(1, frames):
            course = (course + (r.choice([25.0, -25.0, 40.0]) if f % 30 in range(12, 16) else r.uniform(-4, 4))) % 360
            if r.random() < 0.2:
                signs.append([r.choice("abc"), r.randrange(200, 1700), r.randrange(300, 500), r.randrange(6, 16)])
            for s in signs:
                key += 1
                rows.append(det(f, course, s[0], s[1], s[2], drive, e=500_000.0 + 3 * (f % 40), det_id=drive * 100_000 + key, number_sign=f"{s[0]}.{r.choice('1112')}", text=r.choice([None, "", "T"])))
                s[1], s[2], s[3] = s[1] + r.randrange(-30, 30), s[2] - r.randrange(0, 9), s[3] - 1
            signs = [s for s in signs if s[3] > 0]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([r | {"ts": None} for r in rows], SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame")))


OUT = [c for c in tracker.COLUMNS]


def plain_rows(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.select(*OUT).collect()), key=repr)


def test_batch_same_as_the_fold_in_one_process(spark):
    rows = drives()
    got = tracker.tracks_and_turns(frame_of(spark, rows), TURNING)
    kinds = {k: [x for x in got.collect() if x.kind == k] for k in ("track", "turn")}
    want = []
    for d in range(1, 5):
        t, out = run([r for r in rows if r["drive_id"] == d])
        want += [(d, x.number, x.turn_id, len(x.rows)) for x in out if isinstance(x, tracker.Track) and x.number not in t.replaced]
    assert sorted((x.drive_id, x.track_id, x.turn_id, x.observations) for x in kinds["track"]) == sorted(want, key=lambda x: (x[0], x[1]))
    assert kinds["turn"] and any(x.turn_id for x in kinds["track"]) and any(x.turn_id is None for x in kinds["track"])
    assert {(x.drive_id, x.turn_id) for x in kinds["track"] if x.turn_id} <= {(x.drive_id, x.turn_id) for x in kinds["turn"]}
    assert all(len(x.xs) == len(x.ys) == len(x.abs_frames) == x.observations for x in kinds["track"])
    assert tracker.track(frame_of(spark, rows), TURNING).where("kind = 'turn'").count() == 0


def stream_of(spark, tmp_path, batches):
    """A stream that reads one file a batch."""
    import os
    import shutil
    import time

    (tmp_path / "all").mkdir()
    for k, b in enumerate(batches):
        b.coalesce(1).write.json(str(tmp_path / f"in{k}"))
        part = next((tmp_path / f"in{k}").glob("*.json"))
        shutil.copy(part, tmp_path / "all" / f"{k}.json")
        os.utime(tmp_path / "all" / f"{k}.json", (time.time() + k, time.time() + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "all"))


def drained(spark, tmp_path, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()
    return spark.table(name)


def test_stream_same_as_batch_and_idle_drives_are_flushed(spark, tmp_path):
    """Four batches of four drives, then one row far later that moves the watermark on: every drive ends by its timer."""
    rows = drives()
    df = frame_of(spark, rows)
    batches = [df.where((F.col("frame") >= a) & (F.col("frame") < b)) for a, b in ((1, 20), (20, 41), (41, 70), (70, 100))]
    far = [frame_of(spark, [det(f, 0.0, drive=9)]).withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000 + f))) for f in (1, 2)]
    out = drained(spark, tmp_path, track_stream(stream_of(spark, tmp_path, [*batches, *far]), TURNING, idle_ms=60_000, time_col="ts"), "turns_out")
    rows = [tuple(r[c] for c in OUT) for r in out.where("drive_id < 9").select(*OUT).collect()]
    gone = {(r[0], r[OUT.index("replaces")]) for r in rows if r[OUT.index("replaces")] is not None}
    assert sorted((r for r in rows if r[1] is None or r[:2] not in gone), key=repr) == plain_rows(tracker.tracks_and_turns(df, TURNING))


def test_late_frames_are_dropped_and_a_new_drive_starts_after_the_end(spark, tmp_path):
    one = [det(f, 0.0) for f in range(1, 7)]
    again = [det(f, 0.0, e=1000.0 + f) for f in range(1, 7)]
    at = lambda rows, s: frame_of(spark, rows).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + s) + F.col("frame")))
    batches = [at(one, 0), at(one[:3], 0), at([det(1, 0.0, drive=9)], 1000), at([det(2, 0.0, drive=9)], 1001), at(again, 2000), at([det(3, 0.0, drive=9)], 3000), at([det(4, 0.0, drive=9)], 3001)]
    out = drained(spark, tmp_path, track_stream(stream_of(spark, tmp_path, batches), DEFAULT, idle_ms=60_000, time_col="ts"), "late_out")
    assert [(r.track_id, r.observations, r.car_e) for r in out.where("drive_id = 1").orderBy("car_e").collect()] == [(1, 6, 6.0), (1, 6, 1006.0)]


def test_state_holds_active_tracks_and_known_cells_only():
    """What the processor keeps after each batch, with dictionaries for Spark's state."""
    from roadloom.streaming import tracking

    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    class Map(dict):
        containsKey = dict.__contains__
        getValue = dict.__getitem__
        updateValue = dict.__setitem__
        removeKey = dict.pop
        iterator = lambda self: iter(list(self.items()))

    class Handle:
        timers: set = set()
        getValueState = lambda self, *a: Value()
        getMapState = lambda self, *a: Map()
        listTimers = lambda self: iter(list(self.timers))
        registerTimer = lambda self, t: self.timers.add(t)
        deleteTimer = lambda self, t: self.timers.discard(t)

    import pandas as pd

    p = tracking.DriveProcessor(TURNING, 60_000, "ts")
    p.init(Handle())
    rows = [r | {"ts": pd.Timestamp(1_700_000_000 + r["frame"], unit="s")} for r in drives(n=1, frames=200)]
    out, most = [], 0
    for a in range(0, 200, 10):
        part = [r for r in rows if a <= r["frame"] < a + 10]
        if part:
            out += list(p.handleInputRows((1,), iter([pd.DataFrame(part)]), None))
            most = max(most, len(p.tracks))
            assert len(p.handle.timers) == 1
    assert most < 30 and p.known and all(len(v[0]) < 500 for v in p.known.values())
    out += list(p.handleExpiredTimer((1,), None, None))
    assert not p.tracks and not p.known and p.head.v is None
    t, want = run(rows)
    assert sum(len(o) for o in out) == len(want)
