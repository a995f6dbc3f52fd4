"""Video files as a table of frames: a Python data source with one partition a file and the decoder as a hook."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from roadloom.params import DEFAULT, Params

SCHEMA = "video long, name_video string, frame_number long, abs_frame long, gps_index long, image binary, error string"
_START, _END = b"\xff\xd8\xff", b"\xff\xd9"


def jpeg_frames(stream: BinaryIO, block: int = 1 << 20) -> Iterator[bytes]:
    """The pictures of a Motion JPEG stream, read a block at a time; an error if it has none."""
    held, found = b"", False
    while True:
        part = stream.read(block)
        held += part
        while (a := held.find(_START)) >= 0 and (b := held.find(_END, a)) >= 0:
            found = True
            yield held[a : b + len(_END)]
            held = held[b + len(_END) :]
        if not part:
            break
        if held.find(_START) < 0:
            held = held[-len(_START) :]
    if not found:
        raise ValueError("no picture in the stream")


def hook(name: str) -> Callable:
    """The function that `module:function` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def open_input(path: str) -> BinaryIO:
    """A path or an address of any store that Arrow knows, as a stream."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_stream(inner)


class VideoFile(InputPartition):
    def __init__(self, video: int, name: str, path: str):
        self.video, self.name, self.path = video, name, path


class VideoReader(DataSourceReader):
    """Frames of one file after the other; each file is a task, and a lost one is read again from its start."""

    def __init__(self, files: list[tuple[int, str, str]], options: dict):
        self.files = files
        self.decoder, self.opener = options.get("decoder", "roadloom.sources.videos:jpeg_frames"), options.get("opener", "roadloom.sources.videos:open_input")
        self.step = int(options.get("step", "1"))
        self.from_video, self.from_frame = int(options.get("fromvideo", "0")), int(options.get("fromframe", "0"))
        self.images = options.get("images", "true").lower() == "true"
        self.per_video, self.per_point = int(options.get("framespervideo", DEFAULT.frames_per_video)), int(options.get("framesperpoint", DEFAULT.frames_per_point))

    def partitions(self) -> list[InputPartition]:
        return [VideoFile(*f) for f in self.files if f[0] >= self.from_video]

    def read(self, partition: VideoFile | None) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        v, name = partition.video, partition.name
        skipped = self.from_frame if v == self.from_video else 0
        n = 0
        try:
            with hook(self.opener)(partition.path) as stream:
                for n, image in enumerate(hook(self.decoder)(stream), 1):
                    if n > skipped and (n - skipped) % self.step == 0:
                        at = self.per_video * v + n
                        yield v, name, n, at, max(0, (at - 1) // self.per_point), bytes(image) if self.images else None, None
        except Exception as e:  # a bad file is a row, not the end of all
            yield v, name, n, None, None, None, f"{type(e).__name__}: {e}"


class VideoSource(DataSource):
    """Format `videos`; options as in read_videos()."""

    @classmethod
    def name(cls) -> str:
        return "videos"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        import json

        return VideoReader([tuple(f) for f in json.loads(self.options["files"])], self.options)


def read_videos(videos: DataFrame, *, step: int = 1, resume: tuple[int, int] = (0, 0), images: bool = True, decoder: str | None = None, opener: str | None = None, params: Params = DEFAULT) -> DataFrame:
    """Every step-th frame of the videos (video, name_video, path, as roads.list_videos() gives them): SCHEMA.

    Numbers start at 1 in each file; abs_frame counts frames_per_video for every video before. resume is (video, frame): videos
    before it are left out, and its own frames up to that one. A file that can't be opened or breaks off
    gives a last row with its error and the frames read until then. decoder and opener name functions
    (`module:function`): one turns a binary stream into pictures, one a path into a stream.

    The listing, one row a file, goes to the driver, as each file is a task; pictures never do.
    """
    import json

    spark = videos.sparkSession
    spark.dataSource.register(VideoSource)
    files = [(r.video, r.name_video, r.path) for r in videos.select("video", "name_video", "path").orderBy("video").collect()]
    own = {"files": json.dumps(files), "step": str(step), "fromVideo": str(resume[0]), "fromFrame": str(resume[1]), "images": str(images).lower(), "framesPerVideo": str(params.frames_per_video), "framesPerPoint": str(params.frames_per_point)}
    own |= {k: v for k, v in (("decoder", decoder), ("opener", opener)) if v}
    return spark.read.format("videos").options(**own).load()


def frame_counts(videos: DataFrame, **hooks: str) -> DataFrame:
    """video, name_video, frame_count of each file, null for those that can't be read: the files are scanned."""
    frames = read_videos(videos, images=False, **hooks)
    counted = frames.groupBy("video").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n"), F.max("error").alias("error"))
    return videos.select("video", "name_video").join(counted, "video", "left").select("video", "name_video", F.when(F.col("error").isNull(), F.col("n")).alias("frame_count"))

