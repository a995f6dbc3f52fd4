"""Figures of running streams: frames a second, frames and detections so far."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: A rate is given over at least so many seconds.
LEAST_SECONDS = 1.0


def observed(detections: DataFrame, name: str = "detections", frame: str = "frame") -> DataFrame:
    """detections whose batches tell how many rows they have, and how many of them begin a frame (first_of_frame).

    Spark's observe(): the counts come with the query's progress, at no extra job.
    """
    first = F.col("first_of_frame") if "first_of_frame" in detections.columns else F.col(frame).isNotNull()
    return detections.observe(name, F.count("*").alias("detections"), F.count(F.when(first, 1)).alias("frames"), F.max(frame).alias("last_frame"))


@dataclass(frozen=True)
class Figures:
    """frames and detections so far, fps over the last window of a second or more, and the last frame's share of all."""

    frames: int
    detections: int
    fps: float
    last_frame: int | None = None
    progress: int | None = None


class LiveFigures(StreamingQueryListener):
    """Adds up what observed() streams report and hands the sums to `show` whenever a second or more has passed.

    total_frames, if known, gives the progress in whole per cent. clock is for tests.
    """

    def __init__(self, name: str = "detections", show: Callable[[Figures], None] | None = None, total_frames: int | None = None, clock: Callable[[], float] = time.monotonic):
        self.name, self.show, self.total, self.clock = name, show, total_frames, clock
        self.frames = self.detections = self.window = 0
        self.last_frame, self.began, self.fps = None, clock(), 0.0
        self.ended = False
        self.lock = threading.Lock()

    def figures(self) -> Figures:
        done = None if not self.total or self.last_frame is None else int(self.last_frame * 100 // self.total)
        return Figures(self.frames, self.detections, self.fps, self.last_frame, done)

    def add(self, frames: int, detections: int, last_frame: int | None) -> None:
        with self.lock:
            self.frames, self.detections, self.window = self.frames + frames, self.detections + detections, self.window + frames
            self.last_frame = last_frame if self.last_frame is None or (last_frame or 0) > self.last_frame else self.last_frame
            passed = self.clock() - self.began
            if passed < LEAST_SECONDS:
                return
            self.fps, self.window, self.began = self.window / passed, 0, self.clock()
        if self.show is not None:
            self.show(self.figures())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.add(row["frames"] or 0, row["detections"] or 0, row["last_frame"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True


def live(spark: SparkSession, name: str = "detections", show: Callable[[Figures], None] | None = None, total_frames: int | None = None) -> LiveFigures:
    """A listener for the session's streams that observe under this name."""
    listener = LiveFigures(name, show, total_frames)
    spark.streams.addListener(listener)
    return listener


def push(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that hands each batch to send(rows, number) once: a batch that is tried again after a failure, and was
    sent whole before, is left out.

    What was sent is marked beside the checkpoint, after send() has returned, so a batch is lost never and sent twice
    only if the driver dies between the two.
    """
    spark = stream.sparkSession
    jvm = spark._jvm

    def mark(number: int):
        path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/sent/{number}")
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def once(rows: DataFrame, number: int) -> None:
        path, fs = mark(number)
        if fs.exists(path):
            return
        send(rows, number)
        fs.create(path, True).close()
        old, _ = mark(number - 100)  # Spark tries the last batch again, no earlier one
        fs.delete(old, False)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "0 seconds"}).start()
