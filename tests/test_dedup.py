"""Dedup in rounds against the rule applied one feature after the other."""

import random

import pytest

from roadloom.operators import dedup
from roadloom.params import Params

SCHEMA = "seq long, type string, is_left boolean, e double, n double, azimuth double, length int, note string"


def one_by_one(rows, params):
    """seq of the features that stay."""
    held, kept, place = {}, [], {}
    by_seq = {r[0]: r for r in rows}
    for seq, kind, left, e, n, azimuth, length, _ in sorted(rows):
        if e is None or n is None:
            kept.append(seq)
            continue
        cx, cy = int(e // params.cell_m), int(n // params.cell_m)
        twin = None
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                o = by_seq.get(held.get((kind, left, cx + dx, cy + dy)))
                if twin is None and o is not None and azimuth is not None and o[5] is not None:
                    gap = abs(azimuth - o[5])
                    gap = min(gap % 360, 360 - gap % 360) if params.documented else gap
                    if (e - o[3]) ** 2 + (n - o[4]) ** 2 <= params.dedup_radius_m**2 and gap <= params.dedup_azimuth:
                        twin = (kind, left, cx + dx, cy + dy)
        if twin is None:
            held[kind, left, cx, cy] = seq
            place[seq] = len(kept)
            kept.append(seq)
        elif (length or 0) > (by_seq[held[twin]][6] or 0):
            if params.documented:
                place[seq] = place.pop(held[twin])
                kept[place[seq]] = seq
            held[twin] = seq
    return sorted(kept)


def layer(seed, n, wide, kinds=2):
    r = random.Random(seed)
    rows = [(i, f"t{r.randrange(kinds)}", r.random() < 0.5, r.uniform(-wide, wide), r.uniform(-wide, wide), float(r.randrange(0, 360, 5)), r.randrange(1, 9), "x") for i in range(n)]
    poles = [(r.uniform(-wide, wide), r.uniform(-wide, wide)) for _ in range(3)]
    for i in range(n // 2):  # crowds about a few poles
        e, m = r.choice(poles)
        rows.append((n + i, "t0", True, e + r.gauss(0, 15), m + r.gauss(0, 15), r.gauss(90, 20) % 360, r.randrange(1, 30), "x"))
    seqs = r.sample(range(10 * n), len(rows))
    return [(s, *row[1:]) for s, row in zip(seqs, rows)]


@pytest.mark.parametrize("compat", ["documented", "as_written"])
@pytest.mark.parametrize("seed,n,wide,tile", [(1, 300, 200.0, 16), (2, 300, 200.0, 2), (3, 200, 60.0, 1), (4, 400, 5000.0, 16), (5, 300, 100.0, 3)])
def test_rounds_give_what_one_by_one_gives(spark, compat, seed, n, wide, tile):
    rows, params = layer(seed, n, wide), Params(compat=compat)
    got = dedup.grid_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), params, tile=tile)
    assert sorted(r.seq for r in got.collect()) == one_by_one(rows, params)


def test_features_without_place_or_azimuth_stay(spark):
    rows = [(1, "a", True, None, 0.0, 0.0, 3, "x"), (2, "a", True, float("nan"), 0.0, 0.0, 3, "x"), (3, "a", True, 0.0, 0.0, None, 3, "x"), (4, "a", True, 0.0, 0.0, 1.0, 3, "x"), (5, None, None, 0.0, 0.0, 1.0, 3, "x"), (6, None, None, 1.0, 0.0, 1.0, None, "x")]
    got = dedup.grid_dedup(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.seq, r.note) for r in got.collect()) == [(i, "x") for i in (1, 2, 3, 4, 5)]
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_a_task_holds_no_more_than_a_tile(spark):
    """A long row of features that touch each other is one chain, but no group."""
    rows = [(i, "a", True, 15.0 * i, 0.0, 0.0, 1, "x") for i in range(600)]
    placed = dedup._in_tiles(spark.createDataFrame(rows, SCHEMA).selectExpr("type", "is_left", "cast(floor(e / 20) as long) ce", "0L cn", "seq", "e", "n", "azimuth", "cast(length as long) length"), 0, 2, 16, 0)
    assert placed.groupBy("tx", "ty").count().agg({"count": "max"}).first()[0] <= 28  # 20 cells of 20 m
    assert sorted(r.seq for r in dedup.grid_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == one_by_one(rows, Params())


def test_a_crowd_settles_in_few_rounds(spark):
    """4,000 features along 2 km, across the edges of tiles: as one by one, in two rounds."""
    r = random.Random(6)
    rows = [(i, "a", True, r.uniform(-1000, 1000), r.uniform(-20, 20), None if i % 50 == 0 else float(r.randrange(0, 360, 5)), r.randrange(1, 9), "x") for i in range(4000)]
    got = dedup.grid_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), most_rounds=2)
    assert sorted(x.seq for x in got.collect()) == one_by_one(rows, Params())
