"""Vector columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPECIAL = "cast('Infinity' as double), cast('-Infinity' as double), cast('NaN' as double)"


def valid_vector(col: str) -> Column:
    """True where the vector is not null or empty and holds no null or non-finite component."""
    bad = F.exists(F.col(col), lambda x: F.coalesce(~F.abs(x.cast("double")).between(0.0, 1.7976931348623157e308), F.lit(True)))
    return F.coalesce((F.size(F.col(col)) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64; shorter rows end in zeros."""
    if isinstance(column, pa.ListArray) and len(column) and not column.null_count:
        flat, ends = column.flatten(), column.value_lengths().to_numpy()
        if not flat.null_count and (ends == ends[0]).all():
            return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(ends[0]))
    lists = column.to_pylist()
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def keyed_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a list column of doubles: (rows as float64, usable, 128 bits of a hash in two columns).

    Not usable are rows that are null, empty, all zero or hold a null or non-finite component. Equal rows have equal
    hashes; a zero's sign doesn't count.
    """
    flat = column.flatten()
    plain = not column.null_count and not flat.null_count
    lists = None if plain else [None if v is None or None in v else v for v in column.to_pylist()]
    x = matrix(column if plain else pa.array([v or [] for v in lists], pa.list_(pa.float64()))) + 0.0
    ends = (column.value_lengths() if plain else pa.array([len(v or []) for v in lists], pa.int32())).to_numpy()
    usable = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    digests = b"".join(xxhash.xxh3_128_digest(v[:n]) for v, n in zip(x, ends.tolist()))
    return x, usable, np.frombuffer(digests, np.int64).reshape(-1, 2)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow of large components."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def bounded_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """n rows in the order of a hash of their id: the same rows in every run."""
    return df.orderBy(F.xxhash64(F.lit(17), id_col), id_col).limit(n)
