"""Duplicate features near each other."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import azimuth_apart, cell
from roadloom.params import DEFAULT, Params
from roadloom.tables import checkpointed


def near_pairs(points: DataFrame, others: DataFrame, radius_m: float = 20.0) -> DataFrame:
    """Pairs (a_id, b_id, distance) of projected points (id, e, n) of two tables within a radius: a cell join."""
    a = points.select(F.col("id").alias("a_id"), F.col("e").alias("ae"), F.col("n").alias("an"), cell(F.col("e"), radius_m).alias("ce"), cell(F.col("n"), radius_m).alias("cn"))
    b = others.select(F.col("id").alias("b_id"), F.col("e").alias("be"), F.col("n").alias("bn"), F.explode(F.array(*[F.struct((cell(F.col("e"), radius_m) + i).alias("ce"), (cell(F.col("n"), radius_m) + j).alias("cn")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select("b_id", "be", "bn", "c.ce", "c.cn")
    distance = F.sqrt(F.pow(F.col("ae") - F.col("be"), 2) + F.pow(F.col("an") - F.col("bn"), 2))
    return a.join(b, ["ce", "cn"]).withColumn("distance", distance).where(F.col("distance") <= radius_m).select("a_id", "b_id", "distance")


_SETTLED = "what int, type string, is_left boolean, ce long, cn long, seq long, e double, n double, azimuth double, length long, other long"
_ARROW = pa.schema([("what", pa.int32()), ("type", pa.string()), ("is_left", pa.bool_()), ("ce", pa.int64()), ("cn", pa.int64()), ("seq", pa.int64()), ("e", pa.float64()), ("n", pa.float64()), ("azimuth", pa.float64()), ("length", pa.int64()), ("other", pa.int64())])
#: Cells a side of the largest tile; a task keeps what the cells of one tile hold, one feature each.
MOST_TILE = 1024


def grid_dedup(features: DataFrame, params: Params = DEFAULT, tile: int = 256, most_rounds: int = 1000) -> DataFrame:
    """Features (seq, type, is_left, e, n, azimuth, length) without duplicates; the first in the order of seq wins.

    A feature duplicates one that is held for its own cell or one beside it, in the order of these cells, if it is of its
    type and side and within the radius and azimuth. Else it is kept, and its cell holds it from then on. The longer of
    two duplicates is held; documented, it also takes the other's place among the kept (as_written: the first stays).

    What a feature meets depends only on earlier ones at most two cells away. So the plane is cut into tiles, and in each
    round a tile settles, in order, all features that have no unsettled earlier one within two cells, those of other
    tiles' edges included: no two that could meet settle side by side. Tiles lie half a tile further in every other
    round, so what waits at an edge is inside next, and grow twofold up to MOST_TILE, so that crowds take few rounds. A
    task reads the features of a tile in order and keeps what its cells hold, one feature each, however many it reads.

    Defined cases: seq is unique; features without a place (null or NaN e or n) are kept as they are; null azimuths and
    lengths never match and never replace; null types and sides are types and sides of their own; an empty table gives no
    rows; other columns stay.
    """
    placed = F.col("e").isNotNull() & F.col("n").isNotNull() & ~F.isnan("e") & ~F.isnan("n")
    slim = features.where(placed).select("type", F.col("is_left").cast("boolean").alias("is_left"), cell(F.col("e"), params.cell_m).cast("long").alias("ce"), cell(F.col("n"), params.cell_m).cast("long").alias("cn"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in ("e", "n", "azimuth")], F.col("length").cast("long").alias("length"))
    columns = slim.columns
    waiting, held, kept = slim, None, []
    by = ["type", "is_left", "tx", "ty"]
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as small rows take long here
    for i in range(most_rounds):
        size = max(tile, min(tile << min(i, 20), MOST_TILE))
        rows = _in_tiles(waiting, 0, 2, size, i)
        if held is not None:
            busy = rows.where("what = 0").select(*by).distinct()
            near = _in_tiles(held, 2, 1, size, i).alias("r")
            rows = rows.unionByName(near.join(busy.alias("b"), _alike(by, "r", "b"), "left_semi"))
        done = checkpointed(rows.repartition(tasks, *by).sortWithinPartitions(*by, F.col("what") != 2, "seq").mapInArrow(_settle(params), _SETTLED))
        kept.append(done.where("what = 0").select("seq", "other"))
        waiting = done.where("what = 3").select(*columns)
        if waiting.isEmpty():
            break
        new = done.where("what = 2").select(*columns)
        if held is not None:
            new = held.alias("h").join(new.alias("w"), _alike(["type", "is_left", "ce", "cn"], "h", "w"), "left_anti").select(*columns).unionByName(new)
        held = checkpointed(new)
    else:
        raise RuntimeError("duplicates did not settle")
    decided = kept[0]
    for k in kept[1:]:
        decided = decided.unionByName(k)
    stays = decided.select("seq")
    if params.documented:
        stays = stays.join(decided.where("other is not null").select(F.col("other").alias("seq")), "seq", "left_anti")
    lone = features.where(~placed)
    return features.where(placed).join(stays, "seq", "left_semi").select(*features.columns).unionByName(lone)


def _alike(columns: list[str], a: str, b: str) -> Column:
    """Equal in these columns, nulls too."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _in_tiles(rows: DataFrame, what: int, reach: int, tile: int, turn: int) -> DataFrame:
    """rows in every tile that has a cell within `reach`; what is 0 (or as given) in a row's own tile, 1 in others."""
    shift = (turn % 2) * (tile // 2)
    at = lambda c, by: F.floor((F.col(c) - shift + by) / tile).cast("long")
    spread = rows.withColumn("tx", F.explode(F.sequence(at("ce", -reach), at("ce", reach)))).withColumn("ty", F.explode(F.sequence(at("cn", -reach), at("cn", reach))))
    own = (F.col("tx") == at("ce", 0)) & (F.col("ty") == at("cn", 0))
    kind = F.when(own, 0).otherwise(1) if what == 0 else F.lit(what)
    return spread.withColumn("what", kind).select("type", "is_left", "tx", "ty", "what", *[c for c in rows.columns if c not in ("type", "is_left")])


def _settle(params: Params):
    """Rows of tiles, sorted, to what becomes of them: 0 kept (other: the seq that it replaced; the rest is null), 2 held
    by a cell from now on, 3 still waiting; duplicates go. In a tile the rows that cells hold come first; a cell is one
    number."""
    documented, radius, most = params.documented, params.dedup_radius_m**2, params.dedup_azimuth
    beside = [(x << 64) + y for x in (-1, 0, 1) for y in (-1, 0, 1)]
    around = [(x << 64) + y for x in range(-2, 3) for y in range(-2, 3)]

    def twin_of(held: dict, at: int, e: float, n: float, azimuth: float) -> int | None:
        for d in beside:
            o = held.get(at + d)
            if o is not None and (e - o[1]) ** 2 + (n - o[2]) ** 2 <= radius:
                gap = abs(azimuth - o[3])
                if documented:
                    gap = min(gap % 360, 360 - gap % 360)
                if gap <= most:
                    return at + d
        return None

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group, held, changed, blocked = None, {}, set(), set()

        def close() -> Iterator[tuple]:
            for c in changed:
                seq, e, n, azimuth, length = held[c]
                cn = ((c + (1 << 63)) & (1 << 64) - 1) - (1 << 63)
                yield 2, group[0], group[1], (c - cn) >> 64, cn, seq, e, n, azimuth, length, None

        for b in batches:
            for kind, left, tx, ty, what, ce, cn, seq, e, n, azimuth, length in zip(*[_values(b.column(c)) for c in ("type", "is_left", "tx", "ty", "what", "ce", "cn", "seq", "e", "n", "azimuth", "length")]):
                if group != (kind, left, tx, ty):
                    yield from close()
                    group, held, changed, blocked = (kind, left, tx, ty), {}, set(), set()
                at = (ce << 64) + cn
                if azimuth is None:
                    azimuth = float("nan")  # compares with nothing
                if what == 2:
                    held[at] = seq, e, n, azimuth, length
                    continue
                wait = at in blocked
                if what == 1 or wait:
                    blocked.update([at + d for d in around])  # what lies within two cells waits
                    if what == 0:
                        yield 3, kind, left, ce, cn, seq, e, n, azimuth, length, None
                    continue
                twin = twin_of(held, at, e, n, azimuth)
                if twin is None:
                    yield 0, None, None, None, None, seq, None, None, None, None, None
                    twin = at
                elif length is not None and held[twin][4] is not None and length > held[twin][4]:
                    if documented:
                        yield 0, None, None, None, None, seq, None, None, None, None, held[twin][0]
                else:
                    continue
                held[twin] = seq, e, n, azimuth, length
                changed.add(twin)
        yield from close()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = settled(batches)
        while out := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return settle


def _values(column: pa.Array) -> Iterator:
    """A column's values as plain ones, None where it has none."""
    if column.null_count == len(column):
        return repeat(None, len(column))
    return column.to_pylist() if column.null_count or not pa.types.is_primitive(column.type) or pa.types.is_boolean(column.type) else column.to_numpy().tolist()


def azimuth_filter(pairs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    apart = azimuth_apart(F.col("a_azimuth"), F.col("b_azimuth")) if params.documented else F.abs(F.col("a_azimuth") - F.col("b_azimuth"))
    return pairs.where(apart <= params.dedup_azimuth)
