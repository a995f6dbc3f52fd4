"""N-gram Jaccard join of documents by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.cluster_links import cluster_links
from roadloom.llm.common import mix64, ranked, window_hashes, word_hashes, written
from roadloom.llm.graph import component_ids, components

_WORD = re.compile(r"\w+")
_SIGNED = pa.schema([("doc_id", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])


def choose_bands(threshold: float, recall: float, most_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with chance recall.

    More rows a band make fewer false candidates but need more bands; the most rows that most_hashes allows win.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-hit)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("most_hashes is too small for this recall")
    return best


def gram_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, case and punctuation aside.

    A text of fewer words is one shingle of its own length; a text without words has none.
    """
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(h) < n:
        return window_hashes(h, len(h)) ^ np.uint64(len(h))
    return np.unique(window_hashes(h, n))


def band_hashes(grams: np.ndarray, bands: int, rows: int, seeds: np.ndarray, chunk: int = 2048) -> np.ndarray:
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), chunk):
        g = grams[at : at + chunk]
        # multiply-shift: odd multipliers, compared by the high bits
        least = np.minimum(least, (g[:, None] * seeds[0][None, :] + seeds[1][None, :]).min(axis=0))
    least = least.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
    return out.view(np.int64)


def set_id(grams: bytes) -> bytes:
    return hashlib.blake2b(grams, digest_size=16).digest()


def similar(a: list[bytes], b: list[bytes], threshold: float, slab: int = 8192) -> np.ndarray:
    """Boolean matrix: Jaccard of the sets (as bytes of 64-bit hashes) >= threshold."""
    x, y = ([np.frombuffer(s, np.uint64) for s in side] for side in (a, b))
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    fx, fy = np.concatenate(x), np.concatenate(y)
    rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    both = np.intersect1d(fx, fy)
    cx, cy = np.searchsorted(both, fx), np.searchsorted(both, fy)
    mx = (cx < len(both)) & (both[np.minimum(cx, len(both) - 1)] == fx) if len(both) else np.zeros(len(fx), bool)
    my = (cy < len(both)) & (both[np.minimum(cy, len(both) - 1)] == fy) if len(both) else np.zeros(len(fy), bool)
    rx, cx, ry, cy = rx[mx], cx[mx], ry[my], cy[my]
    shared = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(both), slab):
        width = min(slab, len(both) - at)
        p, q = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        i, j = (cx >= at) & (cx < at + width), (cy >= at) & (cy < at + width)
        p[rx[i], cx[i] - at] = 1
        q[ry[j], cy[j] - at] = 1
        shared += p @ q.T
    shared = shared.astype(np.float64)
    union = nx[:, None] + ny[None, :] - shared
    return shared / np.maximum(union, 1) >= threshold


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 256, seed: int = 3) -> DataFrame:
    """One row for each document: doc_id, n_links, component_id, kept.

    n_links counts the other documents whose n-gram set has Jaccard >= threshold with this one's;
    component_id is the smallest doc_id reached by links. Band and row counts come from choose_bands(), so a
    pair at the threshold is found with chance `recall` and closer pairs with more. Documents with equal sets
    are one class. Classes shuffle on band hashes; each meets the smallest class of its band alone, so a band
    with many classes gives as many edges, not pairs. Connected classes form candidate clusters, within which
    all pairs are verified on full n-gram sets, in blocks.

    Defined cases: null and empty texts and texts without words link with nothing; shorter texts than n words
    are one shingle; repeated rows are documents of their own (equal sets, so linked), and so are rows of one id with
    other texts; null ids are dropped;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 2**63, (2, bands * rows), dtype=np.int64).view(np.uint64) * np.uint64(2) + np.array([[1], [0]], np.uint64)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")

    def sign(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [gram_set(t, n) for t in part.column("text").to_pylist()]
                ids = [set_id(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([band_hashes(s, bands, rows, seeds) if len(s) else None for s in sets], pa.list_(pa.int64()))], schema=_SIGNED)

    signed = written(base.mapInArrow(sign, "doc_id long, set_id binary, bands array<long>"), "minhash-signed")
    sets = signed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("weight"), F.first("bands").alias("bands"))
    classes = ranked(sets, ["id", "set_id"], "minhash-classes")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "h"))
    heads = banded.groupBy("band", "h").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "h", "head")
    edges = banded.join(heads, ["band", "h"]).where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    clusters = components(edges, "minhash-candidates")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    placed = clusters.join(sizes, "component").join(classes.select("rep", "id", "weight", "set_id"), clusters.node == F.col("rep")).select(F.col("component").alias("cluster"), "size", "rep", "id", "weight", "set_id")

    def grams(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                i = part.schema.get_field_index("text")
                part = part.set_column(i, "item", pa.array([gram_set(t, n).tobytes() for t in part.column("text").to_pylist()], pa.binary()))
                same = [set_id(s) == i for s, i in zip(part.column("item").to_pylist(), part.column("set_id").to_pylist())]
                yield part.filter(pa.array(same, pa.bool_()))

    # an id may stand on several texts: the set decides which row is meant
    fetched = placed.join(base, placed.id == base.doc_id).select("cluster", "size", "rep", "weight", "set_id", "text")
    members = fetched.mapInArrow(grams, "cluster long, size long, rep long, weight long, set_id binary, item binary").dropDuplicates(["rep"]).drop("set_id")
    found = written(cluster_links(members, lambda a, b: similar(a, b, threshold), block), "minhash-links")
    joined = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "minhash-components")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    named = component_ids(joined, classes)
    state = classes.select("set_id", "rep", "id", "weight").join(links, "rep", "left").join(named, F.col("rep") == named.node, "left").select("set_id", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = signed.select("doc_id", "set_id").join(state, "set_id", "left")
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
