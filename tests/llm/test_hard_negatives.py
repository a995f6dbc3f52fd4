"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import hard_negatives as hn
from roadloom.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, anchor string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 1, "clash") for i, v, l in rows], SCHEMA).repartition(4)


def plain(rows, every=50, positives=5, k=3, least=50, most=95, scale=256):
    """The result by all pairs; of rows alike in all three columns one stays."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            t = tuple(int(np.floor(scale * x)) for x in v)
            good[i, label, t] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, t in good:
        if i % every:
            continue
        scored = sorted((-dot(t, u), j, m) for j, m, u in good if j != i)
        for p, j, m in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and least * -p <= 100 * -x[0] <= most * -p]
            out += [(i, j, r, x[1], -p, -x[0]) for r, x in enumerate(fit[:k], 1)]
    return sorted(out)


def result(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def some(seed=1, n=400, width=6, size=1.0, labels=4):
    r = np.random.default_rng(seed)
    return [(i, (size * r.normal(size=width)).tolist(), int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("size", [0.02, 1.0, 3000.0])
def test_same_as_all_pairs(spark, size):
    rows = some(size=size)
    assert result(hn.hard_negatives(table(spark, rows), every=10)) == plain(rows, every=10)


def test_small_blocks_and_slabs_give_the_same(spark):
    rows = some(2)
    got = hn.hard_negatives(table(spark, rows), every=10, block_rows=32, anchor_rows=4, slab=3, positives=7, k=4, least=20, most=100)
    assert result(got) == plain(rows, every=10, positives=7, k=4, least=20, most=100)


def test_ties_copies_and_odd_rows(spark):
    rows = some(3, 120) + [(1000 + i, [0.5] * 6, i % 3) for i in range(300)] + [(2000, [0.6] * 6, 0), (2000, [0.6] * 6, 0), (2000, [0.7] * 6, 0), (2010, [0.6] * 6, 0), (2010, [0.5] * 6, 1)]
    rows += [(None, [1.0] * 6, 0), (3000, None, 0), (3010, [None] * 6, 0), (3020, [float("nan")] * 6, 1), (3030, [float("inf")] * 6, 1), (3040, [1.0] * 6, None), (3050, [], 0), (3060, [2.0], 1), (3070, [0.0] * 6, 0), (3080, [0.0] * 6, 1)]
    assert result(hn.hard_negatives(table(spark, rows), every=10)) == plain(rows, every=10)


def test_anchors_are_not_broadcast_once_for_each_block(spark):
    """What goes to all blocks is dealt out, however small it is before it is repeated, and isn't more than the index."""
    rows = spark.createDataFrame([(i, i, i % 3, [i, 1]) for i in range(300)], "key long, vec_id long, label long, terms array<long>")
    blocks = rows.select((F.col("key") % 4).alias("block"), "key", "vec_id", "label", "terms")
    index = hn.packed(rows, F.col("key") % 4, 100, "test-index")
    anchors = hn.packed(blocks.where("key % 50 = 0"), F.lit(0).cast("long"), 100, "test-anchors")
    met = hn._met(index, anchors, 4, [])
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 4 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert hn.block_count(717_948, 14_359, 600, 16_384) * 14_359 <= 717_948
    assert hn.block_count(15_000_000, 300_000, 600, 16_384) == 916 and hn.block_count(0, 0, 8, 16_384) == 1


def test_small_tables(spark):
    assert hn.hard_negatives(table(spark, [])).collect() == []
    assert hn.hard_negatives(table(spark, [(50, [1.0, 2.0], 1)])).collect() == []
    assert hn.hard_negatives(table(spark, [(50, [], 1), (51, [], 1), (52, [], 2)])).collect() != []
    assert hn.hard_negatives(table(spark, [(50, [1.0], 1), (51, [-1.0], 1), (52, [-0.6], 2)])).collect() == []


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        hn.hard_negatives(table(spark, [(50, [1e15], 1), (51, [1e15], 1), (52, [1e15], 2)])).collect()


def test_op12_same_as_sql(spark, duck, same_rows, sf_dir):
    assert same_rows(QUERIES["op12_hard_negatives"](spark, sf_dir), duck, ORACLE["op12_hard_negatives"]) > 0
