"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import forget, window_hashes, word_hashes, written
from roadloom.llm.line_dedup import bloom

#: Hashed n-gram features; the models are two vectors of this length, whatever the corpus.
BUCKETS = 10_000
#: Words, and single marks that are neither letters, digits nor space.
_TOKEN = re.compile(r"\w+|[^\w\s]")
RANGES = 4096


def gram_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word and each pair of neighbouring words; a capital word is another word."""
    h = word_hashes(_TOKEN.findall(text or ""))
    return (np.concatenate([window_hashes(h, 1), window_hashes(h, 2)]) % np.uint64(buckets)).astype(np.int64)


def gumbel(seed: int, *cols: str) -> Column:
    """Standard Gumbel noise from a hash: the same for a row in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def importance_resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, temperature: float = 0.02, buckets: int = BUCKETS, seed: int = 5) -> DataFrame:
    """One row a document: doc_id, n_grams, log_ratio, log_weight, sample_key, kept.

    Target text is every document labelled 1, raw text is every document. Each model is the smoothed shares of
    hashed words and word pairs. log_ratio is the log of the ratio of the models for the whole document, a sum over
    its n-grams; log_weight is its mean over them, so that length doesn't decide. The k documents with the largest log_weight / temperature
    plus Gumbel noise are kept: sampling without replacement in proportion to the tempered ratio. k is by
    default the labelled share of target, applied to all documents. The k-th key is found by counting key
    ranges, so no sort sees all documents.

    Defined cases: null and empty texts have no n-grams, log_ratio 0 and log_weight -infinity-like -1e9, so are kept
    last; ties of keys (repeated rows) go in or out together where they straddle k; labels outside 0 and 1 or
    null are ignored, a document labelled twice takes the larger; no target: ratios 0; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        own, rows = np.zeros(buckets, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for at in range(0, b.num_rows, 256):
                grams = [gram_counts(t, buckets) for t in b.column("text").slice(at, 256).to_pylist()]
                own += np.bincount(np.concatenate(grams), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(own)], names=["bucket", "n"])

    def counts(df: DataFrame) -> np.ndarray:
        got = df.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(buckets, np.int64)
        for r in got:
            out[r.bucket] += r.n
        return out

    def shares(n: np.ndarray) -> np.ndarray:
        return (n + 1.0) / (n + 1.0).sum()

    raw = counts(base)
    target = known.where("_y = 1")
    totals = known.agg(F.count("*").alias("n"), F.sum("_y").alias("y")).first()
    ratio = np.zeros(buckets)
    if totals.y:
        # labels may be too many to broadcast, and texts too many to shuffle: all that a filter of fixed size passes is
        # counted where it is read, and what it passes wrongly is counted again and taken off
        passed = base.where(bloom(target, "_id", F.col("doc_id")))
        wrong = written(passed.select("doc_id").distinct().join(target, F.col("doc_id") == target._id, "left_anti").select(F.col("doc_id").alias("_id")), "importance-wrong")
        off = passed.where(bloom(wrong, "_id", F.col("doc_id"))).join(wrong, F.col("doc_id") == wrong._id, "left_semi")
        ratio = np.log(shares(counts(passed) - counts(off)) / shares(raw))
        forget(wrong)
    table = spark.sparkContext.broadcast(ratio)

    def weigh(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                grams = [gram_counts(t, buckets) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array([len(g) for g in grams], pa.int64()), pa.array([float(table.value[g].mean()) if len(g) else -1e9 for g in grams])], names=["doc_id", "h", "n_grams", "log_weight"])

    scored = base.withColumn("h", F.xxhash64("text")).select("doc_id", "text", "h").mapInArrow(weigh, "doc_id long, h long, n_grams long, log_weight double")
    scored = scored.withColumn("log_ratio", F.when(F.col("n_grams") > 0, F.col("n_grams") * F.col("log_weight")).otherwise(0.0))
    keyed = written(scored.withColumn("sample_key", F.col("log_weight") / temperature + gumbel(seed, "doc_id", "h")).drop("h"), "importance-keys")
    if k is None:
        share = (totals.y or 0) / totals.n if totals.n else 1.0
        k = round(keyed.count() * share)
    floor = kth_largest(keyed, "sample_key", k)
    return keyed.select("doc_id", "n_grams", "log_ratio", "log_weight", "sample_key", (F.col("sample_key") >= floor).alias("kept"))


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The k-th largest value of a column of finite doubles; -inf if there are fewer, inf for k < 1.

    Counts equal ranges between the ends, then goes into the one that holds the k-th, until few are left.
    """
    if k < 1:
        return float("inf")
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if n < k:
        return float("-inf")
    for _ in range(12):  # each pass leaves one range of RANGES
        if n <= 50_000 or low == high:
            break
        inside = df.where(F.col(col).between(low, high))
        r = F.least(F.floor((F.col(col) - low) * (RANGES / (high - low))), F.lit(RANGES - 1))
        counts = inside.groupBy(r.alias("r")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).orderBy(F.desc("r")).collect()
        for c in counts:
            if c.n >= k:
                low, high, n = c.low, c.high, c.n
                break
            k -= c.n
    top = df.where(F.col(col).between(low, high)).groupBy(col).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc(col))
    return top.withColumn("run", F.sum("n").over(w)).where(F.col("run") >= k).agg(F.max(col)).first()[0]
