"""Hard-negative mining by distributed radix selection inside score windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import forget, out_batches, partitions, written
from roadloom.llm.topk_search import integer_terms, scores_of

#: Buckets of one digit.
DIGIT = 256
_PACKED = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("dtype", pa.string()), ("keys", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("terms", pa.binary())])
_PACKED_SQL = "block long, n int, width int, dtype string, keys binary, ids binary, labels binary, terms binary"
_SCORED = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_SCORED_SQL = "anchor long, window int, key long, vec_id long, score long"
_COUNTED = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])


def takes_part(col: str) -> Column:
    """True where the vector is not null and holds no null or non-finite component; an empty one takes part."""
    bad = F.exists(F.col(col), lambda x: F.coalesce(~F.abs(x.cast("double")).between(0.0, 1.7976931348623157e308), F.lit(True)))
    return F.coalesce(~bad, F.lit(False))


def packed(rows: DataFrame, block: Column, most: int, name: str) -> DataFrame:
    """rows (key, vec_id, label, terms) in matrices of at most `most` rows of one block, in the smallest integers."""

    def pack(batches):
        def blocks():
            held, now = [], None
            for _, group in _runs(batches, most):
                for r in group:
                    if held and (r["block"] != now or len(held) == most):
                        yield close(now, held)
                        held = []
                    now = r["block"]
                    held.append(r)
            if held:
                yield close(now, held)

        def close(block, rs):
            width = max(len(r["terms"]) for r in rs)
            x = np.zeros((len(rs), width), np.int64)
            for i, r in enumerate(rs):
                x[i, : len(r["terms"])] = r["terms"]
            top = int(np.abs(x.astype(np.float64)).max(initial=0.0))
            if x.size and (x.max() == 2**63 - 1 or x.min() == -(2**63)):  # where the cast to integers ends
                raise OverflowError("a term needs more than 64 bits: use a smaller scale")
            dtype = "int16" if top < 2**15 else "int32" if top < 2**31 else "int64"
            of = lambda c: np.array([r[c] for r in rs], np.int64).tobytes()
            return block, len(rs), width, dtype, of("key"), of("vec_id"), of("label"), x.astype(dtype).tobytes()

        yield from out_batches(blocks(), _PACKED, 16)

    placed = rows.select(block.alias("block"), "key", "vec_id", "label", "terms")
    sorted_ = placed.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block", "key")
    return written(sorted_.mapInArrow(pack, _PACKED_SQL), name)


def _runs(batches, most: int):
    """Rows of the batches, `most` at a time at most."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield at, b.slice(at, most).to_pylist()


def _matrix(r: dict) -> np.ndarray:
    return np.frombuffer(r["terms"], r["dtype"]).reshape(r["n"], r["width"]).astype(np.int64)


def _longs(r: dict, c: str) -> np.ndarray:
    return np.frombuffer(r[c], np.int64)


def _side(df: DataFrame, mark: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{mark}_{c}") for c in df.columns])


def block_count(n_rows: int, n_anchors: int, tasks: int, block_rows: int) -> int:
    """How many blocks of the index there are.

    As many as hold block_rows each; more, for every task, while the anchors, which go to all blocks, then travel as
    no more rows than the index has, or 16 times.
    """
    return max(-(-n_rows // block_rows), min(2 * tasks, -(-n_rows // 256), max(16, n_rows // max(1, n_anchors))), 1)


def _met(index: DataFrame, anchors: DataFrame, blocks: int, extra: list[str]) -> DataFrame:
    """Each block of the index beside each block of anchors: the anchors, the smaller side, go to all blocks.

    They are dealt to them and never broadcast: Spark would judge by their size before they are repeated, and the
    driver would hold them `blocks` times.
    """
    sent = anchors.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    a = _side(sent.select("to", "n", "width", "dtype", "keys", "ids", "labels", "terms", *extra), "a")
    return _side(index, "x").join(a.hint("merge"), F.col("x_block") == F.col("a_to")).drop("a_to", "x_block")


def _opened(batches):
    """For each row of _met: (index block, block of anchors, their matrices, exact).

    exact: matrices of floats that give scores without rounding; else they are of 64-bit integers.
    """
    for b in batches:
        for k in range(b.num_rows):
            r = b.slice(k, 1).to_pylist()[0]
            x, a = ({c[2:]: v for c, v in r.items() if c.startswith(m)} for m in ("x_", "a_"))
            if "windows" in a:
                a["windows"] = np.array([list(w.values()) for w in a["windows"]], np.int64).reshape(-1, 6)
            xm, am = _matrix(x), _matrix(a)
            width = max(xm.shape[1], am.shape[1])
            xm, am = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (xm, am))
            most = float(np.abs(xm.astype(np.float64)).max(initial=0.0) * np.abs(am.astype(np.float64)).max(initial=0.0)) * width
            kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64
            yield x, a, xm.astype(kind), am.astype(kind), kind is not np.int64


def _times(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer scores of anchors and rows."""
    if not a.shape[1]:
        return np.zeros((len(a), len(x)), np.int64)
    return (a @ x.T).astype(np.int32 if a.dtype == np.float32 else np.int64) if exact else scores_of(a, x)


def _scores(batches, slab: int):
    """For each row of _met, its anchors in slabs: (row, first anchor, scores, fit).

    fit: rows that aren't of the anchor's own id or label.
    """
    for x, a, xm, am, exact in _opened(batches):
        for at in range(0, len(am), slab):
            part = slice(at, at + slab)
            fit = (_longs(a, "ids")[part, None] != _longs(x, "ids")[None, :]) & (_longs(a, "labels")[part, None] != _longs(x, "labels")[None, :])
            yield x, a, at, _times(am[part], xm, exact), fit


def _inside(scores: np.ndarray, fit: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where rows fit and lie between the least low and the largest high of their anchor's windows."""
    ends = np.iinfo(scores.dtype)
    least, most = np.full(len(scores), ends.max, np.int64), np.full(len(scores), ends.min, np.int64)
    np.minimum.at(least, places, low)
    np.maximum.at(most, places, high)
    least, most = (np.clip(x, ends.min, ends.max).astype(scores.dtype)[:, None] for x in (least, most))
    return fit & (scores >= least) & (scores <= most)


def _first(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The places among `at` of the k highest scores, ties to smaller ids."""
    if len(at) > 4 * k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _positives(index: DataFrame, anchors: DataFrame, blocks: int, k: int, slab: int) -> DataFrame:
    """The first k rows of the label of each anchor (by its key): a few from each block, then of these."""

    def best(batches):
        def rows():
            for x, a, xm, am, exact in _opened(batches):
                ids, keys, labels, own = _longs(x, "ids"), _longs(x, "keys"), _longs(x, "labels"), _longs(a, "labels")
                for label in np.unique(own):
                    # where scores may not fit, all are made, so that one that doesn't is an error
                    cols = np.nonzero(labels == label)[0] if exact else np.arange(len(ids))
                    of = np.nonzero(own == label)[0]
                    for at in range(0, len(of), slab):
                        part = of[at : at + slab]
                        s = _times(am[part], xm[cols], exact)
                        fit = (_longs(a, "ids")[part, None] != ids[None, cols]) & (labels[cols] == label)[None, :]
                        for i, ok in enumerate(fit):
                            for j in _first(s[i], ids[cols], np.nonzero(ok)[0], k):
                                yield int(_longs(a, "keys")[part[i]]), 0, int(keys[cols[j]]), int(ids[cols[j]]), int(s[i, j])

        yield from out_batches(rows(), _SCORED)

    found = _met(index, anchors, blocks, []).mapInArrow(best, _SCORED_SQL)
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def _asked(windows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Blocks of anchors with their windows: rows (place in the block, window, low, high, ...) side by side."""
    at = windows.groupBy("block").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("place", "window", "low", "high", "from", "size")])).alias("windows"))
    return anchors.join(at, "block")


def _windows(a: dict, at: int, n: int) -> np.ndarray:
    """The windows of anchors at .. at + n of a block: columns place, window, low, high, from, size."""
    w = a["windows"]
    return w[(w[:, 0] >= at) & (w[:, 0] < at + n)]


def _histogram(index: DataFrame, asked: DataFrame, blocks: int, k: int, slab: int) -> DataFrame:
    """Counts of scores in each window's buckets, from the highest bucket down to the one where a block has k.

    What a block holds below its own k-th score can't hold the k-th of all. A bucket is a digit: the distance of
    the score below `from`, in steps of `size`.
    """

    def count(batches):
        def rows():
            for x, a, at, s, fit in _scores(batches, slab):
                w = _windows(a, at, len(s))
                # the digits open are from `top` down to DIGIT * size below it, and never under the window
                lows = [max(low, top - DIGIT * size + 1) for _, _, low, _, top, size in w.tolist()]
                inside = _inside(s, fit, w[:, 0] - at, np.array(lows, np.int64), w[:, 4])
                held = {}
                for (place, window, _, _, top, size), low in zip(w.tolist(), lows):
                    if place not in held:
                        held[place] = s[place - at][inside[place - at]].astype(np.int64)
                    own = held[place]
                    own = own[(own <= top) & (own >= low)]
                    if not len(own):
                        continue
                    n = np.bincount((top - own) // size, minlength=1)
                    last = int(np.searchsorted(np.cumsum(n), k))
                    key = int(_longs(a, "keys")[place])
                    for bucket in np.nonzero(n[: last + 1])[0].tolist():
                        yield key, window, bucket, int(n[bucket])

        yield from out_batches(rows(), _COUNTED)

    met = _met(index, asked, blocks, ["windows"])
    return met.mapInArrow(count, "anchor long, window int, bucket long, n long").groupBy("anchor", "window", "bucket").agg(F.sum("n").alias("n"))


def _refined(windows: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """windows with the bucket of the k-th score as the range of the next digit.

    need: how many rows of the range are taken, besides all above it. A window with fewer rows isn't open any more
    and takes all that it holds.
    """
    w = Window.partitionBy("anchor", "window").orderBy("bucket")
    upto = counts.withColumn("upto", F.sum("n").over(w))
    at = upto.join(windows.select("anchor", "window", "need"), ["anchor", "window"]).where("upto >= need").groupBy("anchor", "window").agg(F.min(F.struct("bucket", "n", "upto")).alias("b"))
    out = windows.join(at, ["anchor", "window"], "left")
    found = F.col("b").isNotNull() & F.col("open")
    return out.select(
        "anchor", "block", "place", "window", "low", "high",
        F.when(found, F.col("from") - F.col("b.bucket") * size).otherwise(F.col("from")).alias("from"),
        F.when(found, F.col("need") - (F.col("b.upto") - F.col("b.n"))).otherwise(F.col("need")).alias("need"),
        found.alias("open"), F.lit(max(1, size // DIGIT)).alias("size"),
    )


def _gathered(index: DataFrame, asked: DataFrame, blocks: int, k: int, slab: int) -> DataFrame:
    """Rows of each window at or above its threshold (`from`); of equal scores at most k from a block."""

    def gather(batches):
        def rows():
            for x, a, at, s, fit in _scores(batches, slab):
                ids, keys = _longs(x, "ids"), _longs(x, "keys")
                w = _windows(a, at, len(s))
                low = np.maximum(w[:, 2], w[:, 4])
                inside = _inside(s, fit, w[:, 0] - at, low, w[:, 3])
                held = {}
                for (place, window, _, high, *_), low in zip(w.tolist(), low.tolist()):
                    i = place - at
                    if place not in held:
                        held[place] = np.nonzero(inside[i])[0]
                    own = held[place]
                    for j in _first(s[i], ids, own[(s[i, own] >= low) & (s[i, own] <= high)], k):
                        yield int(_longs(a, "keys")[place]), window, int(keys[j]), int(ids[j]), int(s[i, j])

        yield from out_batches(rows(), _SCORED)

    return _met(index, asked, blocks, ["windows"]).mapInArrow(gather, _SCORED_SQL)


def hard_negatives(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = 5, k: int = 3,
    least: int = 50, most: int = 95, scale: int = 256, block_rows: int = 16_384, anchor_rows: int = 1024, slab: int = 64,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: up to k for each anchor and positive.

    Anchors are rows whose id is divisible by `every`; their positives the first rows of their label, their
    negatives the first rows of other labels whose score lies in the window from least to most per cent of the
    positive's. A score is the inner product of floor(scale * x). Rows stand in blocks of at most block_rows; anchors
    go to all blocks, block_rows grows no further, and no task holds more than a block and anchor_rows anchors. For
    each window the blocks count scores by the highest digit of their distance from the window's top; the bucket of
    the k-th score is the range of the next digit, until a bucket is one score: the threshold, above which
    rows are gathered.

    Defined cases: rows with a null id, label or vector or any null or non-finite component take no part; shorter
    vectors end in zeros, so an empty one scores 0; a row that repeats another's id, label and vector counts once, and
    rows that repeat an id alone are rows of their own, but an anchor never meets rows of its own id; ties go to the
    smaller id; an anchor without positives, and a positive without negatives in its window, give no rows; a positive
    below zero has no window; a score beyond 64 bits raises OverflowError; an empty table gives no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("v"))
    rows = rows.where("vec_id is not null and label is not null").where(takes_part("v")).select("vec_id", "label", integer_terms("v", scale).alias("terms")).distinct()
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "negatives-rows")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks = block_count(n_rows, n_anchors, partitions(spark), block_rows)
    chunks = max(1, -(-n_anchors // anchor_rows))
    spread = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    index = packed(rows, spread(blocks), block_rows, "negatives-index")
    anchors = packed(rows.where(F.col("vec_id") % every == 0), spread(chunks), anchor_rows, "negatives-anchors")
    forget(rows)
    # blocks of anchors are numbered anew: a crowded one was cut
    anchors = anchors.drop("block").withColumn("block", F.monotonically_increasing_id())
    anchors = written(anchors.select("block", *[c for c in anchors.columns if c != "block"]), "negatives-asked")

    def places(batches):
        for b in batches:
            for block, keys, ids in zip(b.column("block").to_pylist(), b.column("keys").to_pylist(), b.column("ids").to_pylist()):
                at = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(np.arange(len(at), dtype=np.int32)), pa.array(at), pa.array(np.frombuffer(ids, np.int64))], names=["block", "place", "anchor", "anchor_id"])

    placed = anchors.select("block", "keys", "ids").mapInArrow(places, "block long, place int, anchor long, anchor_id long")
    pairs = written(_positives(index, anchors, blocks, positives, slab).join(placed, "anchor"), "negatives-positives")
    # positives of one score share a window; the per cents are taken of whole hundreds and the rest, lest they overflow
    share = lambda per, up: F.expr(f"positive_score div 100 * {per} + ((positive_score % 100) * {per} + {up}) div 100")
    w = Window.partitionBy("anchor").orderBy(F.desc("positive_score"))
    scored = pairs.where("positive_score >= 0").withColumns({"window": F.dense_rank().over(w), "low": share(least, 99), "high": share(most, 0)})
    scored = written(scored.where("low <= high"), "negatives-pairs")
    forget(pairs)
    windows = scored.select("anchor", "block", "place", "window", "low", "high").distinct()
    widest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    size = 1
    while widest is not None and size * DIGIT <= widest:
        size *= DIGIT
    windows = windows.withColumns({"from": F.col("high"), "need": F.lit(k).cast("long"), "open": F.lit(True), "size": F.lit(size)})
    windows = written(windows, "negatives-windows")
    while size:
        counts = _histogram(index, _asked(windows.where("open"), anchors), blocks, k, slab)
        after = written(_refined(windows, counts, size), "negatives-windows")
        forget(windows)
        windows, size = after, size // DIGIT
    thresholds = windows.withColumn("from", F.when(F.col("open"), F.col("from")).otherwise(F.col("low")))
    found = _gathered(index, _asked(thresholds, anchors), blocks, k, slab)
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "key")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scored.join(best.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
