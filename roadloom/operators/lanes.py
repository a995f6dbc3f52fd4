"""Lane signs from arrow masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.catalog import LANE_DIRECTIONS


def coverage(mask: Column, w: Column, h: Column) -> Column:
    """Share of nonzero cells in percent, half-even; mask is array<array<double>>."""
    cells = F.flatten(mask)
    return F.when(w * h > 0, F.bround(F.size(F.filter(cells, lambda x: x != 0)) * 100.0 / (w * h), 0)).otherwise(0.0)


def has_gap(row: Column) -> Column:
    """Is there a 1, then a 0, then a 1 in a row of cells?"""
    state = F.aggregate(row, F.lit(0), lambda s, x: F.when((s == 0) & (x == 1), 1).when((s == 1) & (x == 0), 2).when((s == 2) & (x == 1), 3).otherwise(s))
    return F.coalesce(state == 3, F.lit(False))


def arrow_masks(signs: DataFrame, keys: list[str]) -> DataFrame:
    """arrows of signs: every mask cut by every box. signs: keys, masks (array of masks of the sign's picture), boxes
    (array of structs x1, y1, x2, y2, direction). A sign has a few of each, so the pairs are made inside its row.

    Returns keys, seq (masks first, boxes inside), direction, mask, w, h, centre_row.
    """
    met = signs.select(*keys, "boxes", F.posexplode("masks").alias("_m", "_mask")).select(*keys, "_m", "_mask", F.posexplode("boxes").alias("_b", "_box"))
    b = F.col("_box")
    cut = lambda row: F.slice(row, b["x1"] + 1, F.greatest(b["x2"] - b["x1"], F.lit(0)))
    rows = F.transform(F.slice("_mask", b["y1"] + 1, F.greatest(b["y2"] - b["y1"], F.lit(0))), cut)
    centre = F.get("_mask", b["y1"] + F.floor((b["y2"] - b["y1"]) / 2).cast("int"))
    return met.select(*keys, (F.col("_m") * 1000 + F.col("_b")).alias("seq"), b["direction"].alias("direction"), rows.alias("mask"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"), centre.alias("centre_row"))


def lane_types(arrows: DataFrame, keys: list[str]) -> DataFrame:
    """lane_type of a sign: codes of its arrows joined by hyphens. arrows: keys, seq, direction, mask, w, h, centre_row.

    An arrow counts if its mask covers over a quarter of its box; ahead adds nothing; back counts only with a gap.
    """
    sure = F.col("direction").isin(*LANE_DIRECTIONS) & ((F.col("direction") != "back") | has_gap(F.col("centre_row"))) & (coverage(F.col("mask"), F.col("w"), F.col("h")) > 25)
    code = F.element_at(F.create_map(*[F.lit(x) for kv in LANE_DIRECTIONS.items() for x in kv]), F.col("direction"))
    found = arrows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(sure, F.struct("seq", code.alias("c"))))).alias("_c"))
    return found.select(*keys, F.array_join(F.transform("_c", lambda s: s["c"]), "-").alias("lane_type"))
