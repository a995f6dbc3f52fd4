"""The multi-frame tracker: a small state machine for one drive, applied to each drive by Spark."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, MutableMapping
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

from roadloom.functions.geo import geodesic_m
from roadloom.params import DEFAULT, Params

#: Columns of tracks and turns; kind says which a row is. A turn has number, frames, points and azimuths only.
SCHEMA = (
    "drive_id long, track_id long, name_sign string, number_sign string, mode_count int, observations int, is_side boolean, is_left boolean, azimuth double, car_e double, car_n double, lat double, lon double, "
    "first_frame long, last_frame long, det_ids array<long>, frames array<long>, xs array<int>, replaces long, kind string, ys array<int>, ws array<int>, hs array<int>, car_es array<double>, car_ns array<double>, "
    "abs_frames array<long>, sides array<boolean>, texts array<string>, num long, turn_id long, turn_direction string, number string, coordinates array<struct<lat:double,lon:double>>, azimuths array<double>"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: What a detection must have, and what it may have.
INPUT = ["drive_id", "frame", "det_id", "name_sign", "number_sign", "x", "y", "w", "h", "is_side", "course", "car_e", "car_n", "lat", "lon"]
OPTIONAL = ["abs_frame", "text"]
#: Place on a turn (a key of catalog.TURN_ANCHORS) of a sign last seen in its first, second and last third. Our definition.
TURN_PLACES = ("0", "5", "3")


@dataclass
class Track:
    number: int
    rows: list[dict] = field(default_factory=list)
    coarse: Counter = field(default_factory=Counter)
    fine: Counter = field(default_factory=Counter)
    azimuth: float = 0.0
    replaces: int | None = None
    #: the car's places (easting, northing, lat, lon), one for each new easting
    cars: list[tuple] = field(default_factory=list)
    num: int = 0
    turn_id: int | None = None
    direction: str = "straight"
    place: str | None = None
    changed: bool = True

    def add(self, det: dict) -> None:
        self.rows.append(det)
        self.coarse[det["name_sign"]] += 1
        self.fine[det["number_sign"]] += 1
        if not self.cars or det["car_e"] != self.cars[-1][0]:
            self.cars.append((det["car_e"], det["car_n"], det["lat"], det["lon"]))
        self.changed = True

    @property
    def last(self) -> dict:
        return self.rows[-1]

    @property
    def at(self) -> tuple:
        """The car's last place: easting, northing, lat, lon."""
        return self.cars[-1]

    @property
    def votes(self) -> int:
        return self.fine.most_common(1)[0][1]

    def best(self, counter: Counter) -> str:
        return counter.most_common(1)[0][0]

    def moved_to(self, det: dict) -> float:
        return round(math.hypot(det["x"] - self.last["x"], det["y"] - self.last["y"]), 1)


@dataclass
class Turn:
    """A turn of the drive: the frames at which its course changes by more than a limit, one after the other."""

    number: int
    frames: list[int] = field(default_factory=list)
    #: easting, northing, lat, lon
    points: list[tuple] = field(default_factory=list)
    azimuths: list[float] = field(default_factory=list)
    #: tracks were active while it lasted
    held: bool = False

    def add(self, frame: int, det: dict) -> None:
        self.frames.append(frame)
        self.points.append((det["car_e"], det["car_n"], det["lat"], det["lon"]))
        self.azimuths.append(det["course"])

    @property
    def direction(self) -> str:
        return "right" if len(self.azimuths) < 2 or wrapped(self.azimuths[-1] - self.azimuths[0]) >= 0 else "left"

    def place_of(self, frame: int) -> str:
        """Where on the turn a sign stands that was last seen at this frame."""
        share = (frame - self.frames[0]) / max(1, self.frames[-1] - self.frames[0])
        return TURN_PLACES[min(2, max(0, int(3 * share)))]


def wrapped(degrees: float) -> float:
    return degrees - 360 if degrees > 180 else degrees + 360 if degrees < -180 else degrees


class KnownSigns:
    """Signs that are known already, by cells of space, so that a look costs the same however many there are.

    Cells are cubes of the radius's size about the earth's centre: no distance on the ground is shorter than the chord, so
    what lies within the radius lies in the cell or in one beside it. cells: any mapping from a cell to its signs.
    """

    def __init__(self, radius_m: float, cells: MutableMapping | None = None, made: int = 0):
        self.radius, self.cells, self.made = radius_m, {} if cells is None else cells, made

    def cell(self, lat: float, lon: float) -> tuple[int, int, int]:
        a, flat = 6_378_137.0, 1 / 298.257223563
        sin, cos = math.sin(math.radians(lat)), math.cos(math.radians(lat))
        normal = a / math.sqrt(1 - flat * (2 - flat) * sin * sin)
        x, y, z = normal * cos * math.cos(math.radians(lon)), normal * cos * math.sin(math.radians(lon)), normal * (1 - flat) ** 2 * sin
        return math.floor(x / self.radius), math.floor(y / self.radius), math.floor(z / self.radius)

    def near(self, kind: str, left: bool, lat: float | None, lon: float | None) -> dict | None:
        """The sign of this class and side nearer than the radius that has been known for longest."""
        if lat is None or lon is None:
            return None
        x, y, z = self.cell(lat, lon)
        found = [s for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) for s in self.cells.get((kind, left, x + i, y + j, z + k), ()) if geodesic_m(s["lat"], s["lon"], lat, lon) < self.radius]
        return min(found, key=lambda s: s["seq"], default=None)

    def add(self, kind: str, left: bool, lat: float | None, lon: float | None, votes: int, number: int) -> None:
        if lat is None or lon is None:
            return
        self.made += 1
        key = (kind, left, *self.cell(lat, lon))
        self.cells[key] = [*self.cells.get(key, ()), {"lat": lat, "lon": lon, "votes": votes, "number": number, "seq": self.made}]

    def drop(self, kind: str, left: bool, sign: dict) -> None:
        key = (kind, left, *self.cell(sign["lat"], sign["lon"]))
        rest = [s for s in self.cells.get(key, ()) if s["seq"] != sign["seq"]]
        if rest:
            self.cells[key] = rest
        else:
            del self.cells[key]

    def clear(self) -> None:
        self.cells.clear()


def same_box_share(a: dict, b: dict) -> float:
    wide = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    high = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    area = a["w"] * a["h"]
    return 100 * wide * high / area if wide > 0 and high > 0 and area else 0.0


class DriveTracker:
    """State of one drive: active tracks, signs that are known, the turn that is open. Feed frames in order, then flush().

    With turn_change set, a turn opens where the course changes by more than that from one frame to the next and
    closes at the first frame where it doesn't. While tracks are active in it none of them ends. At its end, tracks with
    enough votes that were last seen before its last frame leave as signs of the turn; the others take its points for the
    car's places. A turn of a single point, or without tracks, is none.
    """

    def __init__(self, params: Params = DEFAULT, known: KnownSigns | None = None):
        self.p, self.active, self.made, self.frame = params, [], 0, -1
        self.known = KnownSigns(params.known_radius_m) if known is None else known
        self.replaced: set[int] = set()
        self.turn: Turn | None = None
        self.turns, self.course = 0, None

    def feed(self, frame: int, detections: list[dict]) -> list[Track | Turn]:
        """Take the detections of one frame; tracks that this frame ends and the turn that it closes. Frames not after
        the last are late and dropped."""
        if not detections or frame <= self.frame:
            return []
        self.frame = frame
        turning = self._steer(frame, detections[0])
        out: list[Track | Turn] = [] if turning or self.turn is None else self._close_turn()
        if self.active:
            detections = self._without_twins(detections)
            detections = self._extend(frame, detections)
        for det in detections:
            self.made += 1
            self.active.append(Track(self.made, azimuth=0.0))
            self.active[-1].add(det)
        for t in self.active:
            if t.last["frame"] == frame:
                t.azimuth = t.last["course"]
        self._forget_lost()
        if not (turning and self.turn.held):
            ended = [t for t in self.active if frame - t.last["frame"] >= self.p.finish_gap and t.votes >= self.p.least_observations]
            out += self._finish(ended)
        if turning:
            self.turn.held = self.turn.held or bool(self.active)
        return out

    def flush(self) -> list[Track | Turn]:
        """What is open at the end of the drive: its turn, and tracks that are mature."""
        if not self.p.documented:
            return []
        out = self._close_turn() if self.turn else []
        return out + self._finish([t for t in self.active if t.votes >= self.p.least_observations])

    def _steer(self, frame: int, det: dict) -> bool:
        """Is the car turning at this frame? Its course joins the open turn if so."""
        if self.p.turn_change is None or det["course"] is None:
            return False
        before, self.course = self.course, det["course"]
        if before is None or abs(wrapped(self.course - before)) <= self.p.turn_change:
            return False
        if self.turn is None:
            self.turns += 1
            self.turn = Turn(self.turns)
        self.turn.add(frame, det)
        return True

    def _close_turn(self) -> list[Track | Turn]:
        turn, self.turn = self.turn, None
        if not turn.held or len(turn.points) < 2:
            return []
        self._forget_lost()
        on = [t for t in self.active if t.votes >= self.p.turn_observations and t.last["frame"] < turn.frames[-1]]
        for t in on:
            t.turn_id, t.direction, t.place = turn.number, turn.direction, turn.place_of(t.last["frame"])
        self.active = [t for t in self.active if t.turn_id is None]
        for t in self.active:
            t.cars, t.changed = list(turn.points), True
        return [turn, *on]

    def _forget_lost(self) -> None:
        self.active = [t for t in self.active if self.frame - t.last["frame"] <= self.p.remove_gap or t.votes >= self.p.least_observations]

    def _finish(self, ended: list[Track]) -> list[Track]:
        gone = {t.number for t in ended}
        self.active = [t for t in self.active if t.number not in gone]
        out = [t for t in ended if not self._is_known(t)]
        if not self.p.documented:
            self.known.clear()
        return out

    def _is_known(self, new: Track) -> bool:
        """A track of the same class and side nearby is known already, unless the new one has more votes and replaces it."""
        kind, left, (_, _, lat, lon) = new.best(new.fine), self.side(new), new.at
        old = self.known.near(kind, left, lat, lon)
        if old is not None:
            if new.votes <= old["votes"]:
                return True
            new.replaces = old["number"]
            self.replaced.add(old["number"])
            self.known.drop(kind, left, old)
        self.known.add(kind, left, lat, lon, new.votes, new.number)
        return False

    def side(self, t: Track) -> bool:
        if len(t.rows) == 1:
            third = self.p.screen_width / 3
            return (self.p.screen_width - t.last["w"] <= third) == (self.p.screen_width - t.last["x"] <= third)
        return t.rows[0]["x"] > t.last["x"]

    def _without_twins(self, detections: list[dict]) -> list[dict]:
        gone = set()
        for i, a in enumerate(detections):
            for j in range(i + 1, len(detections)):
                b = detections[j]
                if a["name_sign"] == b["name_sign"] and same_box_share(a, b) > self.p.overlap_percent:
                    gone.add(i if a["w"] * a["h"] < b["w"] * b["h"] else j)
        return [d for i, d in enumerate(detections) if i not in gone]

    def _extend(self, frame: int, detections: list[dict]) -> list[dict]:
        """Add detections to tracks; what is left starts tracks."""
        p, wish = self.p, []
        for t in self.active:
            kind, best = t.best(t.coarse), (p.invalid, -1)
            for k, d in enumerate(detections):
                if d["y"] - t.last["y"] > p.most_drop:
                    continue
                far = t.moved_to(d) + (-p.same_class_bonus if kind == d["name_sign"] else p.other_class_penalty)
                if far <= p.most_pixels and far < best[0]:
                    best = (far, k)
            wish.append([best[0], best[1] if best[1] >= 0 else 0, kind])
        # of tracks that want one detection: compared pair by pair, in order
        for i in range(len(wish)):
            for j in range(i + 1, len(wish)):
                if wish[i][1] != wish[j][1] or not detections:
                    continue
                name = detections[wish[i][1]]["name_sign"]
                mine, other = wish[i][2] == name, wish[j][2] == name
                lose = j if mine and not other else i if other and not mine else j if wish[i][0] <= wish[j][0] else i
                wish[lose][0] = p.invalid
        taken: set[int] = set()
        for t, (far, k, _) in zip(self.active, wish):
            if far < p.invalid and frame - t.last["frame"] < p.match_gap:
                t.add(detections[k])
                t.num = detections[k]["abs_frame"]
                taken.add(k)
        free = [k for k in range(len(detections)) if k not in taken]
        attached: set[int] = set()
        for t, (far, _, _) in zip(self.active, wish):
            for k in free:
                if t.best(t.coarse) == detections[k]["name_sign"]:
                    moved = t.moved_to(detections[k])
                    if moved != 0 and abs(moved - far) <= p.vector_slack:
                        t.add(detections[k])
                        attached.add(k)
                        break
        return [d for k, d in enumerate(detections) if k not in taken and k not in attached]


def out_row(tracker: DriveTracker, drive: int, t: Track | Turn) -> tuple:
    """A row of SCHEMA for a track or a turn."""
    if isinstance(t, Turn):
        own = {"kind": "turn", "turn_id": t.number, "turn_direction": t.direction, "frames": t.frames, "first_frame": t.frames[0], "last_frame": t.frames[-1], "coordinates": [{"lat": p[2], "lon": p[3]} for p in t.points], "azimuths": t.azimuths}
        return tuple(drive if c == "drive_id" else own.get(c) for c in COLUMNS)
    n, sides, at, of = len(t.rows), sum(bool(r["is_side"]) for r in t.rows), t.at, lambda c: [r[c] for r in t.rows]
    return (
        drive, t.number, t.best(t.coarse), t.best(t.fine), t.votes, n, 2 * sides > n, tracker.side(t), t.azimuth, *at, t.rows[0]["frame"], t.last["frame"], of("det_id"), of("frame"), of("x"), t.replaces,
        "track", of("y"), of("w"), of("h"), [c[0] for c in t.cars], [c[1] for c in t.cars], of("abs_frame"), [bool(x) for x in of("is_side")], [x for x in of("text") if x], t.num, t.turn_id, t.direction, t.place, None, None,
    )


def tracker_rows(detections: DataFrame, *more: str) -> DataFrame:
    """INPUT and OPTIONAL columns, and more: without abs_frame the frame stands for it, without text there is none."""
    from pyspark.sql import functions as F

    own = {"abs_frame": F.col("frame").cast("long"), "text": F.lit("")}
    return detections.select(*INPUT, *[F.col(c) if c in detections.columns else own[c].alias(c) for c in OPTIONAL], *more)


def plain(v):
    """A value of a pandas row, NaN and NaT as None."""
    return None if v is None or v != v else v


def records(frames: Iterable[pd.DataFrame], names: list[str]) -> Iterator[dict]:
    """Rows of these columns, one after the other."""
    for pdf in frames:
        for r in zip(*(pdf[c].tolist() for c in names)):
            yield dict(zip(names, map(plain, r)))


def frames_of(pdf: pd.DataFrame) -> Iterator[tuple[int, list[dict]]]:
    rows = records([pdf.sort_values(["frame", "det_id"], kind="stable")], [*INPUT, *OPTIONAL])
    for frame, group in groupby(rows, key=lambda r: r["frame"]):
        yield int(frame), list(group)


def out_frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of SCHEMA; whole numbers that may be missing stay whole."""
    pdf = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    whole = {c.split()[0]: "Int64" if c.endswith(" long") else "Int32" for c in SCHEMA.split(", ") if c.endswith((" long", " int"))}
    return pdf.astype(whole | {c.split()[0]: "Float64" for c in SCHEMA.split(", ") if c.endswith(" double")})


def track(detections: DataFrame, params: Params = DEFAULT, cut_gap: int | None = None) -> DataFrame:
    """Tracks of detections (INPUT columns), one row a track; see tracks_and_turns()."""
    out = tracks_and_turns(detections, params, cut_gap)
    return out if params.turn_change is None else out.where("kind = 'track'")


def tracks_and_turns(detections: DataFrame, params: Params = DEFAULT, cut_gap: int | None = None) -> DataFrame:
    """Tracks and turns of detections, as rows that `kind` tells apart: one fold over each drive gives both.

    A track that a better one of the same sign replaced isn't given; `replaces` names it on the better one. Tracks that
    left on a turn have its turn_id and their place on it (number); such signs aren't looked up among those known.

    A drive is a fold over its sorted frames, which pass by: a task holds a drive's state, never its rows; drives run side by
    side. Rows without a frame go, rows without a drive are one drive. A drive is also cut where no detection stands for
    more than cut_gap frames: by then every track has ended or is lost, so pieces are independent but for the
    drive-wide duplicate check, which needs the whole drive; cut_gap is therefore for compat "as_written", without turns.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = tracker_rows(detections).where("frame is not null")
    keys = ["drive_id"]
    if cut_gap is not None:
        if params.documented or params.turn_change is not None:
            raise ValueError("pieces of a drive can't see each other's tracks")
        w = Window.partitionBy("drive_id").orderBy("frame", "det_id")
        rows = rows.withColumn("_piece", F.sum(F.when(F.col("frame") - F.lag("frame").over(w) > cut_gap, 1).otherwise(0)).over(w))
        keys = ["drive_id", "_piece"]

    def kept(tracker: DriveTracker, drive: int, ended: list[Track | Turn]) -> list[tuple]:
        return [out_row(tracker, drive, t) for t in ended if isinstance(t, Turn) or t.number not in tracker.replaced]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for key, drive in groupby(records(frames, [*INPUT, *OPTIONAL, *keys[1:]]), key=lambda r: tuple(r[k] for k in keys)):
            tracker = DriveTracker(params)
            for frame, dets in groupby(drive, key=lambda r: r["frame"]):
                out += kept(tracker, key[0], tracker.feed(frame, list(dets)))
                if len(out) >= 500:
                    yield out_frame(out)
                    out = []
            out += kept(tracker, key[0], tracker.flush())
            if params.documented:
                out += [tuple({"drive_id": key[0], "track_id": n, "kind": "replaced"}.get(c) for c in COLUMNS) for n in tracker.replaced]
        yield out_frame(out)

    made = rows.repartition(*keys).sortWithinPartitions(*keys, "frame", "det_id").mapInPandas(fold, SCHEMA)
    if not params.documented:
        return made  # signs are known for a frame only, so a replaced one has been left out
    gone = F.max(F.col("kind") == "replaced").over(Window.partitionBy("drive_id", "track_id"))
    return made.withColumn("_gone", gone).where(~F.col("_gone")).drop("_gone")
