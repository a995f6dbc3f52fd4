"""The video source over real files, and layers behind a pointer."""

import io

import pytest
from pyspark.sql import functions as F

from roadloom.params import Params
from roadloom.sources import geojson, layers, roads, videos
from roadloom.tables import numbered


def picture(i):
    return b"\xff\xd8\xff" + bytes([i % 251]) * 50 + b"\x00\xff\xd9"


def movie(path, n, junk=b"RIFFxxxx"):
    path.write_bytes(junk + b"".join(b"00dc" + picture(i) for i in range(1, n + 1)) + b"idx1")


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "videos"
    f.mkdir()
    movie(f / "a.mp4", 12)
    movie(f / "b.MP4", 7)
    (f / "c.mp4").write_bytes(b"no picture at all")
    movie(f / "d.mp4", 5)
    (f / "e.txt").write_bytes(picture(1))
    return f


def test_pictures_of_a_stream_whatever_the_blocks():
    data = b"\xff" + b"".join(picture(i) + b"\x01" * i for i in range(40))
    for block in (1, 3, 7, 64, 1 << 20):
        assert list(videos.jpeg_frames(io.BytesIO(data), block)) == [picture(i) for i in range(40)]
    with pytest.raises(ValueError):
        list(videos.jpeg_frames(io.BytesIO(b"\xff\xd8 nothing")))


def test_frames_of_all_files(spark, folder):
    listed = roads.list_videos(spark, str(folder))
    assert [(r.video, r.name_video) for r in listed.orderBy("video").collect()] == [(0, "a.mp4"), (1, "b.MP4"), (2, "c.mp4"), (3, "d.mp4")]
    got = videos.read_videos(listed, params=Params(frames_per_video=100, frames_per_point=4))
    assert got.rdd.getNumPartitions() == 4
    rows = got.collect()
    good = [r for r in rows if r.error is None]
    assert [(r.video, r.frame_number) for r in good] == [(v, i) for v, n in ((0, 12), (1, 7), (3, 5)) for i in range(1, n + 1)]
    assert all(bytes(r.image) == picture(r.frame_number) and r.abs_frame == 100 * r.video + r.frame_number and r.gps_index == (r.abs_frame - 1) // 4 for r in good)
    assert [(r.video, r.frame_number, r.error) for r in rows if r.error] == [(2, 0, "ValueError: no picture in the stream")]


def test_steps_and_resume(spark, folder):
    listed = roads.list_videos(spark, str(folder))
    rows = videos.read_videos(listed, step=3, resume=(1, 2), images=False).where("error is null").collect()
    assert [(r.video, r.frame_number) for r in rows] == [(1, 5), (3, 3)] and all(r.image is None for r in rows)


def test_frame_sum_of_scanned_files(spark, folder):
    counts = videos.frame_counts(roads.list_videos(spark, str(folder)))
    assert sorted((r.video, r.frame_count) for r in counts.collect()) == [(0, 12), (1, 7), (2, None), (3, 5)]
    assert roads.frame_count(counts).first().frames == 24


def test_a_file_that_is_gone_is_a_row(spark, folder):
    listed = roads.list_videos(spark, str(folder)).withColumn("path", F.when(F.col("video") == 1, F.lit(str(folder / "gone.mp4"))).otherwise(F.col("path")))
    rows = videos.read_videos(listed).where("video = 1").collect()
    assert len(rows) == 1 and "FileNotFoundError" in rows[0].error
    assert videos.read_videos(listed.where("video > 9")).count() == 0


def lines_of(stream):
    for line in stream.read().splitlines():
        if line == b"broken":
            raise OSError("cut off")
        yield line


def open_text(path):
    return open(path.removeprefix("file:"), "rb")


def test_hooks_and_files_that_break_off(spark, tmp_path, monkeypatch):
    """A decoder and an opener of one's own; what was read before a fault stays."""
    module = tmp_path / "own_decoder.py"
    import inspect

    module.write_text(inspect.getsource(lines_of) + "\n\n" + inspect.getsource(open_text))
    spark.sparkContext.addPyFile(str(module))
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "t.mp4").write_bytes(b"one\ntwo\nbroken\nthree")
    listed = spark.createDataFrame([(0, "t.mp4", str(tmp_path / "t.mp4"))], "video long, name_video string, path string")
    rows = videos.read_videos(listed, decoder="own_decoder:lines_of", opener="own_decoder:open_text").collect()
    assert [(r.frame_number, r.image and bytes(r.image), r.error) for r in rows] == [(1, b"one", None), (2, b"two", None), (2, None, "OSError: cut off")]


def test_numbers_across_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit(1).alias("_at")).repartition(13)
    got = numbered(df, ["k"])
    assert [r.number for r in got.orderBy("k").collect()] == list(range(5000)) and got.columns == ["k", "_at", "number"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert numbered(df.where("k < 0"), ["k"]).count() == 0


def test_a_layer_is_swapped_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "layer")
    with pytest.raises(FileNotFoundError):
        layers.read_layer(spark, path)
    layers.write_layer(spark.range(3), path)
    assert layers.read_layer(spark, path).count() == 3
    # from the layer in force to the next one
    layers.write_layer(layers.read_layer(spark, path).where("id > 0"), path, "json")
    assert sorted(r.id for r in layers.read_layer(spark, path).collect()) == [1, 2]

    def fails(*a):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(layers, "point_to", fails)
        with pytest.raises(OSError):
            layers.write_layer(spark.range(9), path)
    with pytest.raises(Exception):
        layers.write_layer(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert sorted(r.id for r in layers.read_layer(spark, path).collect()) == [1, 2]
    assert layers.drop_old(spark, path) >= 2
    assert sorted(r.id for r in layers.read_layer(spark, path).collect()) == [1, 2]
    assert layers.drop_old(spark, path) == 0


def test_a_layer_of_features_round_trip(spark, tmp_path):
    rows = geojson.empty_features(spark)
    layers.write_layer(rows, str(tmp_path / "f"))
    assert layers.read_layer(spark, str(tmp_path / "f")).schema == rows.schema
