"""What several operators share: written intermediate tables, sorted groups, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a local session (tests, a laptop) that names no shared folder keeps intermediate tables.
LOCAL_CHECKPOINTS = "/tmp/roadloom-checkpoints"
#: Spark's switch that deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[DataFrame]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only a local master may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or LOCAL_CHECKPOINTS).rstrip("/")


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the tables that written() made inside, but for those with keep=True."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for table in _SCOPES.pop():
            forget(table)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the jobs inside, and are as before after them."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of this one query go when it ends, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(table)
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by written() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df written with rep: a number for each row that ascends with these columns. One id may stand on several rows."""
    rows = df.repartitionByRange(partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    return written(rows.withColumn("rep", F.monotonically_increasing_id()), name)


def private(*taken: str) -> str:
    """A prefix that none of these column names starts with."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in taken):
        mark += "_"
    return mark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_in_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of consecutive rows with equal keys; a group may span Arrow batches."""
    rows = chain.from_iterable(b.to_pylist() for b in batches)
    for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield key, list(group)


def by_sorted_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn over the Arrow batches of each partition, with the rows of a key together and sorted.

    One Python call a partition instead of one a group: most groups here are pairs.
    """
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInArrow(fn, schema)


def out_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def id_crc32(col: str | Column) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(None)).cast("string").cast("binary"))


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words met before; bounded."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.LIMIT and len(word) < 64:
            self[word] = h
        return h


_WORDS = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive values; empty where there are fewer."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix64(out)
