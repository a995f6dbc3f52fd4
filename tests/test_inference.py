"""Models over crops with fake models, and figures of running streams."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators import clean, inference
from roadloom.params import Params
from roadloom.streaming import live


def given(column, log=None, key=""):
    """A model that reads its probabilities from the picture: a text of rows parted by '|'."""

    def load():
        if log:
            with open(log, "a") as f:
                f.write(f"{key} {os.getpid()}\n")

        def predict(pictures):
            if log:
                with open(log + ".batches", "a") as f:
                    f.write(f"{key} {len(pictures)}\n")
            return np.array([[float(x) for x in p.split("|")[column].split(",")] for p in pictures])

        return predict

    return load


COARSE = ("treugolnik", "krug", "5.8", "5.16.2", "7.13", "plain")


def cascade(log=None):
    art = lambda key, column, names: inference.Artifact(key + (log or ""), given(column, log, key), names)
    return inference.Cascade(art("coarse", 0, COARSE), {"treugolnik": art("tri", 1, ("1.1", "1.20", "")), "krug": art("krug", 1, ("3.1", "3.2", "3.3"))}, {"1.20": art("hop", 2, ("1.20.1", "1.20.2"))}, lambda: lambda pictures: [[("left", 0.9), ("right", 0.64), ("ahead", 0.9), ("back", 0.65)] for _ in pictures])


def text(*parts):
    return "|".join(",".join(map(str, p)) for p in parts)


def one(i, n=6, p=0.9):
    return [p if k == i else (1 - p) / (n - 1) for k in range(n)]


CASES = [
    (1, text(one(0), [0.7, 0.2, 0.1], [0.1, 0.2]), "treugolnik", "1.1"),
    (2, text(one(0), [0.1, 0.8, 0.1], [0.1, 0.2]), "treugolnik", "1.20.2"),  # the second hop, however sure
    (3, text(one(0), [0.59, 0.41, 0], [1, 0]), None, None),  # not sure
    (4, text(one(0), [0.1, 0.1, 0.8], [1, 0]), "treugolnik", "treugolnik"),  # a model without a name for it
    (5, text(one(1), [0.2, 0.2, 0.6]), "krug", "3.3"),
    (6, text(one(1), [0.4, 0.4, 0.2]), None, None),
    (7, text(one(2)), "5.8", "4.1.3-6.3.1"),
    (8, text(one(3)), None, None),
    (9, text(one(4)), "7.13.1", "7.13.1"),
    (10, text(one(5)), "plain", "plain"),
    (11, text(one(5, p=0.69)), None, None),
    (12, None, None, None),
    (13, text([0.7, 0.7, 0, 0, 0, 0], [0.8, 0, 0], [1, 0]), "treugolnik", "1.1"),  # the first of equals
]


@pytest.mark.parametrize("batch", [1, 2, 64])
def test_cascade(spark, batch):
    df = spark.createDataFrame([(i, p, "clash") for i, p, _, _ in CASES], "det_id long, picture string, name_sign string").repartition(3)
    got = {r.det_id: (r.name_sign, r.number_sign) for r in inference.classify(df, cascade(), batch=batch).collect()}
    assert got == {i: (a, b) for i, _, a, b in CASES if b is not None}
    assert inference.classify(df.where("det_id < 0"), cascade()).count() == 0


def test_models_load_once_a_worker_and_get_batches_of_a_class(spark, tmp_path):
    log = str(tmp_path / "loads")
    df = spark.createDataFrame([(i, text(one(i % 2), [0.1, 0.8, 0.1], [0.3, 0.2])) for i in range(3000)], "det_id long, picture string").repartition(16)
    assert inference.classify(df, cascade(log), batch=50).count() == 3000
    loads = open(log).read().splitlines()
    assert len(loads) == len(set(loads)) and {x.split()[0] for x in loads} == {"coarse", "tri", "krug", "hop"}
    sizes = [int(x.split()[1]) for x in open(log + ".batches").read().splitlines()]
    assert max(sizes) == 50 and len(sizes) < 3000


def test_second_hop_and_threshold_same_as_in_sql(spark, same_rows, duck, sf_dir):
    """Given probabilities of the events' detections: models and SQL agree."""
    from roadloom.plans.views import DET_SQL, detections

    k = F.col("k")
    # coarse: class by k % 3 of (treugolnik, krug, plain); fine: tenths by k; second hop by k % 2
    d = detections(spark, sf_dir).select("det_id", k)
    coarse = F.array(*[F.when(k % 3 == i, 0.8).otherwise(0.1) for i in (0, 1)], *[F.lit(0.0)] * 3, F.when(k % 3 == 2, 0.8).otherwise(0.1))
    fine = F.array((k % 10 / 10.0), 1 - k % 10 / 10.0, F.lit(0.0))
    hop = F.array((k % 2).cast("double"), F.lit(0.5))
    made = d.select("det_id", F.concat_ws("|", *[F.array_join(c.cast("array<string>"), ",") for c in (coarse, fine, hop)]).alias("picture"))
    got = inference.classify(made, cascade()).select("det_id", "name_sign", "number_sign")
    sql = f"""with {DET_SQL}, f as (select det_id, k, case k % 3 when 0 then 'treugolnik' when 1 then 'krug' else 'plain' end as name_sign, (k % 10) / 1e1 as a, 1 - (k % 10) / 1e1 as b from det)
    select det_id, name_sign, case when name_sign = 'plain' then 'plain' when name_sign = 'krug' then case when a >= b then '3.1' else '3.2' end when a >= b then '1.1' when k % 2 = 1 then '1.20.1' else '1.20.2' end as number_sign
    from f where name_sign = 'plain' or greatest(a, b) >= 0.6"""
    assert same_rows(got, duck, sql) > 0


def test_fps_needs_a_second():
    now, shown = [0.0], []
    figures = live.LiveFigures(show=shown.append, total_frames=1000, clock=lambda: now[0])
    for at, frames in ((0.4, 30), (0.9, 20), (1.25, 50), (1.5, 10), (3.25, 10)):
        now[0] = at
        figures.add(frames, 2 * frames, frames * 5)
    assert [(f.frames, f.detections, f.fps) for f in shown] == [(100, 200, 80.0), (120, 240, 10.0)]
    assert figures.figures().last_frame == 250 and figures.figures().progress == 25


def test_stream_tells_its_figures_and_pushes_each_batch_once(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(f'{{"frame": {10 * k + i // 2}, "first_of_frame": {str(i % 2 == 0).lower()}}}' for i in range(20)))
        os.utime(src / f"{k}.json", (time.time() + k, time.time() + k))
    schema = "frame long, first_of_frame boolean"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    sent = []

    def send(rows, number):
        sent.append((number, rows.count()))
        if number == 1 and len(sent) == 2:
            raise OSError("the map is away")

    listener = live.live(spark, "seen")
    try:
        run = lambda: live.push(live.observed(stream(), "seen"), send, str(tmp_path / "cp"), availableNow=True)
        with pytest.raises(Exception):
            run().awaitTermination(120)
        run().awaitTermination(120)
        assert sent == [(0, 20), (1, 20), (1, 20), (2, 20)]
        for _ in range(100):
            if listener.frames >= 30:
                break
            time.sleep(0.1)
        assert (listener.frames, listener.detections, listener.last_frame) == (30, 60, 29)
    finally:
        spark.streams.removeListener(listener)
    # a batch that was sent whole and is tried again is left out
    assert {int(p.name) for p in (tmp_path / "cp" / "sent").iterdir() if not p.name.startswith(".")} == {0, 1, 2}


def test_fine_class_of_given_columns_agrees(spark):
    d = spark.createDataFrame([(1, "krug", [0.2, 0.2, 0.6], None), (2, "plain", None, None)], "det_id long, name_sign string, fine_probabilities array<double>, lane_type string")
    got = {r.det_id: r.number_sign for r in clean.fine_class(d, ["krug"], {"krug": ["3.1", "3.2", "3.3"]}, Params()).collect()}
    assert got == {1: "3.3", 2: "plain"}
