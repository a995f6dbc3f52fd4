"""The tracker over a stream of detections, with its state kept by drive, track and cell."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, MutableMapping
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from roadloom.operators.tracker import SCHEMA, DriveTracker, KnownSigns, Track, Turn, frames_of, out_frame, out_row, tracker_rows
from roadloom.params import DEFAULT, Params

#: Spark's setting for where state is kept, and the store that keeps it by key.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CellState(MutableMapping):
    """Known signs by cell in a map state: only the cells that are looked at are read, only changed ones are written."""

    def __init__(self, state):
        self.state, self.read, self.dirty = state, {}, set()

    def _key(self, key: tuple) -> tuple[str]:
        return (json.dumps(key),)

    def __getitem__(self, key: tuple) -> list[dict]:
        if key not in self.read:
            k = self._key(key)
            self.read[key] = json.loads(self.state.getValue(k)[0]) if self.state.containsKey(k) else []
        if not self.read[key]:
            raise KeyError(key)
        return self.read[key]

    def __setitem__(self, key: tuple, signs: list[dict]) -> None:
        self.read[key] = signs
        self.dirty.add(key)

    def __delitem__(self, key: tuple) -> None:
        self[key] = []

    def __iter__(self) -> Iterator[tuple]:
        raise TypeError("cells are looked up, not listed")

    def __len__(self) -> int:
        raise TypeError("cells are looked up, not counted")

    def clear(self) -> None:
        self.read, self.dirty = {}, set()
        self.state.clear()

    def save(self) -> None:
        for key in self.dirty:
            if self.read[key]:
                self.state.updateValue(self._key(key), (json.dumps(self.read[key]),))
            elif self.state.containsKey(self._key(key)):
                self.state.removeKey(self._key(key))
        self.dirty = set()


def track_text(t: Track) -> str:
    return json.dumps(asdict(t) | {"coarse": None, "fine": None})


def track_from(text: str) -> Track:
    d = json.loads(text)
    d |= {"coarse": Counter(r["name_sign"] for r in d["rows"]), "fine": Counter(r["number_sign"] for r in d["rows"]), "cars": [tuple(c) for c in d["cars"]], "changed": False}
    return Track(**d)


class DriveProcessor(StatefulProcessor):
    """State of a drive: its head (frame, numbers, open turn), active tracks by number, known signs by cell.

    What ends leaves the state, but for the known signs' places; a timer clears a drive that has gone quiet.
    """

    def __init__(self, params: Params, idle_ms: int | None, time_col: str | None):
        self.params, self.idle_ms, self.time_col = params, idle_ms, time_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "head string")
        self.tracks = handle.getMapState("tracks", "number long", "track string")
        self.known = handle.getMapState("known", "cell string", "signs string")

    def _load(self) -> DriveTracker:
        cells = CellState(self.known) if self.params.documented else {}
        head = json.loads(self.head.get()[0]) if self.head.exists() else {}
        t = DriveTracker(self.params, KnownSigns(self.params.known_radius_m, cells, head.get("known", 0)))
        if head:
            t.made, t.frame, t.turns, t.course = head["made"], head["frame"], head["turns"], head["course"]
            t.turn = Turn(**head["turn"] | {"points": [tuple(p) for p in head["turn"]["points"]]}) if head["turn"] else None
            t.active = [track_from(v[0]) for _, v in sorted((k[0], v) for k, v in self.tracks.iterator())]
        return t

    def _save(self, t: DriveTracker, before: set[int]) -> None:
        self.head.update((json.dumps({"made": t.made, "frame": t.frame, "turns": t.turns, "course": t.course, "known": t.known.made, "turn": asdict(t.turn) if t.turn else None}),))
        for number in before - {a.number for a in t.active}:
            self.tracks.removeKey((number,))
        for a in t.active:
            if a.changed:
                self.tracks.updateValue((a.number,), (track_text(a),))
        if isinstance(t.known.cells, CellState):
            t.known.cells.save()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        tracker = self._load()
        before = {a.number for a in tracker.active}
        out = [out_row(tracker, int(key[0]), t) for frame, dets in frames_of(pdf) for t in tracker.feed(frame, dets)]
        self._save(tracker, before)
        if self.idle_ms is not None:
            now = int(pdf[self.time_col].max().timestamp() * 1000) if self.time_col else timerValues.getCurrentProcessingTimeInMs()
            timers = list(self.handle.listTimers())
            ends = max([now + self.idle_ms, *timers])  # a late batch doesn't bring the end forward
            for at in timers:
                if at != ends:
                    self.handle.deleteTimer(at)
            if ends not in timers:
                self.handle.registerTimer(ends)
        yield out_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracker = self._load()
        out = [out_row(tracker, int(key[0]), t) for t in tracker.flush()]
        for state in (self.head, self.tracks, self.known):
            state.clear()
        yield out_frame(out)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, params: Params = DEFAULT, idle_ms: int | None = None, time_col: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Tracks, and turns if params has them, as they end; `kind` tells them apart.

    Each batch of a drive is sorted by frame; frames at or before the last one are late and dropped. A track that came
    out may be replaced by a better one of the same sign later: that one's `replaces` is its track_id.

    idle_ms: a drive without detections for so long is flushed (documented) and its state goes: by the event time of
    time_col, with a watermark `late` behind it, or else by the clock. Rows behind the watermark are dropped by Spark.

    State needs the RocksDB store; it is set where the session names none.
    """
    spark = detections.sparkSession
    if not spark.conf.get(STORE, None):
        spark.conf.set(STORE, ROCKSDB)
    rows = tracker_rows(detections, time_col).withWatermark(time_col, late) if time_col else tracker_rows(detections)
    mode = "None" if idle_ms is None else "EventTime" if time_col else "ProcessingTime"
    return rows.groupBy("drive_id").transformWithStateInPandas(statefulProcessor=DriveProcessor(params, idle_ms, time_col), outputStructType=SCHEMA, outputMode="Append", timeMode=mode)
