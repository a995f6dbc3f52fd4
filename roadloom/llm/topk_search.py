"""Exact top-k search by integer inner product, block at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import out_batches, partitions, rows_in_groups, written
from roadloom.llm.vectors import bounded_sample, matrix, valid_vector

_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("index", pa.binary()), ("query_ids", pa.binary()), ("query_hashes", pa.binary()), ("floors", pa.binary())])
_HIT = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_terms(col: str, scale: int = 64) -> Column:
    return F.transform(F.col(col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: by float64 where no sum can pass 2**53, in 64-bit integers where none can pass
    these, else in integers of any length."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    most = np.abs(x).max(initial=0.0) * np.abs(y).max(initial=0.0) * a.shape[1]
    if most < 2.0**53:
        return (x @ y.T).astype(np.int64)
    return a @ b.T if most < 2.0**62 else a.astype(object) @ b.astype(object).T


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """products() as 64-bit integers; an error where one doesn't fit."""
    s = products(a, b)
    if s.dtype == object and s.size and not -(2**63) <= s.min() <= s.max() < 2**63:
        raise OverflowError("a score needs more than 64 bits: use a smaller scale")
    return s.astype(np.int64)


def large_terms(rows: list[list[int]]) -> np.ndarray:
    """Rows of integers that float64 can't hold; shorter rows end in zeros."""
    width = max(map(len, rows))
    return np.array([r + [0] * (width - len(r)) for r in rows], np.int64)


def block_bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query and block, the sum over terms of the largest product that the block can hold."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return np.clip(products(up, most) + products(down, least), -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.nonzero(scores >= floor)[0]
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64, block_rows: int = 256, group_blocks: int = 64, chunk: int = 4096, sample: int = 20_000) -> DataFrame:
    """For each vector whose id is divisible by `every`, its k best others: query_id, rank, vec_id, score.

    Vectors are ordered by the signs of their main directions (learned on `sample` vectors, the documented
    bound; it only shapes blocks, never results) and cut into blocks of block_rows, each with its forward
    index. A query's k-th score inside its own block is its first floor. Then groups of blocks meet chunks
    of queries: for each query, blocks in the order of their summed term maxima are scored until the bound
    falls below the k-th score. The lists of all groups are merged. Results are exact.

    Defined cases: vectors that are null, empty or hold null or non-finite components take no part; shorter
    vectors end in zeros; a term or a compared score that doesn't fit 64 bits raises OverflowError in its task; ties go to the smaller
    vec_id; repeated rows are candidates of their own, but a query never meets rows of its own id, and
    repeated queries (id and vector) answer once, and vectors of one id answer each; null ids take no part; with fewer candidates than k all are returned; an
    empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & valid_vector("v")).select("vec_id", integer_terms("v", scale).alias("terms")).withColumn("hash", F.xxhash64("terms"))
    fit = matrix(pa.array([r.terms for r in bounded_sample(rows, "vec_id", sample).collect()] or [[0]]))
    fit = fit - fit.mean(axis=0)
    fit /= max(1.0, float(np.abs(fit).max()))
    main = np.linalg.eigh(fit.T @ fit)[1][:, ::-1][:, :12]
    signs = [F.when(F.aggregate(F.zip_with("terms", F.array(*[F.lit(float(w)) for w in main[:, j]]), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) > 0, 1 << (11 - j)).otherwise(0) for j in range(main.shape[1])]
    place = signs[0]
    for s in signs[1:]:
        place = place + s
    ordered = rows.withColumn("place", place).repartitionByRange(partitions(spark), "place", "vec_id").sortWithinPartitions("place", "vec_id")

    def cut(batches):
        base, i, held = TaskContext.get().partitionId() << 32, 0, []

        def close(rs):
            if any(not -(2**63) < v < 2**63 - 1 for r in rs for v in r[1]):  # where the cast ends
                raise OverflowError("a term needs more than 64 bits: use a smaller scale")
            x = matrix(pa.array([r[1] for r in rs])).astype(np.int64) if all(abs(v) < 2**53 for r in rs for v in r[1]) else large_terms([r[1] for r in rs])
            ids = np.array([r[0] for r in rs], np.int64)
            asked = [j for j, v in enumerate(ids) if v % every == 0]
            floors = []
            for j in asked:
                own = scores_of(x[j : j + 1], x[ids != ids[j]])[0]
                floors.append(int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else -(2**63))
            return base + i, len(rs), x.shape[1], ids.tobytes(), x.tobytes(), np.array(asked, np.int64).tobytes(), np.array([rs[j][2] for j in asked], np.int64).tobytes(), np.array(floors, np.int64).tobytes()

        def made():
            nonlocal i, held
            for b in batches:
                for r in zip(b.column("vec_id").to_pylist(), b.column("terms").to_pylist(), b.column("hash").to_pylist()):
                    held.append(r)
                    if len(held) == block_rows:
                        yield close(held)
                        i, held = i + 1, []
            if held:
                yield close(held)

        yield from out_batches(made(), _BLOCK, 64)

    blocks = written(ordered.mapInArrow(cut, "block long, n int, width int, ids binary, index binary, query_ids binary, query_hashes binary, floors binary"), "topk-blocks")
    n_blocks, n_queries = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("query_ids") / 8), F.lit(0.0))).first()
    groups, chunks = max(1, -(-n_blocks // group_blocks)), max(1, -(-int(n_queries) // chunk))
    group_of = F.pmod(F.xxhash64("block"), F.lit(groups))
    chunk_of = F.pmod(F.xxhash64(F.lit(5), "block"), F.lit(chunks))
    # a block of the index goes to all chunks of queries; its queries go to all groups of blocks
    index = blocks.select(group_of.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("c"), F.lit(0).alias("asks"), "block", "width", "ids", "index", *[F.lit(None).cast("binary").alias(c) for c in ("query_ids", "query_hashes", "floors")])
    asks = blocks.where(F.length("query_ids") > 0).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), chunk_of.alias("c"), F.lit(1).alias("asks"), "block", "width", "ids", "index", "query_ids", "query_hashes", "floors")
    asks = asks.mapInArrow(_only_queries, asks.schema)

    def search(batches):
        def hits():
            for _, group in rows_in_groups(batches, ["g", "c"]):
                width = max(r["width"] for r in group)

                def terms(r):
                    x = np.frombuffer(r["index"], np.int64).reshape(-1, r["width"])
                    return np.pad(x, ((0, 0), (0, width - r["width"])))

                held = [(np.frombuffer(r["ids"], np.int64), terms(r)) for r in group if not r["asks"]]
                ask = [r for r in group if r["asks"]]
                if not held or not ask:
                    continue
                q = np.vstack([terms(r) for r in ask])
                qid, qhash = (np.concatenate([np.frombuffer(r[c], np.int64) for r in ask]) for c in ("ids", "query_hashes"))
                floor = np.concatenate([np.frombuffer(r["floors"], np.int64) for r in ask])
                bounds = block_bounds(q, np.vstack([x.max(axis=0) for _, x in held]), np.vstack([x.min(axis=0) for _, x in held]))
                order = np.argsort(-bounds, axis=1, kind="stable")
                for i in range(len(q)):
                    kth, score, ids = int(floor[i]), np.empty(0, np.int64), np.empty(0, np.int64)
                    for b in order[i]:
                        if bounds[i, b] < kth:
                            break
                        own, x = held[b]
                        if (other := own != qid[i]).sum() < len(own):
                            own, x = own[other], x[other]
                        s = scores_of(q[i : i + 1], x)[0]
                        keep = s >= kth
                        if keep.any():
                            score, ids = np.concatenate([score, s[keep]]), np.concatenate([ids, own[keep]])
                            at = best(score, ids, k)
                            score, ids = score[at], ids[at]
                            if len(score) == k:
                                kth = max(kth, int(score[-1]))
                    yield from zip([int(qid[i])] * len(ids), [int(qhash[i])] * len(ids), ids.tolist(), score.tolist())

        yield from out_batches(hits(), _HIT)

    pairs = index.union(asks)
    n = max(partitions(spark), 1)
    found = pairs.repartition(n, "g", "c").sortWithinPartitions("g", "c").mapInArrow(search, "query_id long, query_hash long, vec_id long, score long")
    w = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id", "_copy")
    found = found.groupBy("query_id", "query_hash", "vec_id", "score").agg(F.count("*").alias("_n"))
    asked_twice = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), F.col("hash").alias("query_hash")).agg(F.count("*").alias("_asked"))
    found = found.join(asked_twice, ["query_id", "query_hash"]).select("query_id", "query_hash", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.expr("_n div _asked"))).cast("int"))).alias("_copy"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _only_queries(batches):
    """Of each block its queries alone: the index rows at the places in query_ids."""
    for b in batches:
        ids, index = [], []
        for i, x, at, width in zip(b.column("ids").to_pylist(), b.column("index").to_pylist(), b.column("query_ids").to_pylist(), b.column("width").to_pylist()):
            places = np.frombuffer(at, np.int64)
            ids.append(np.frombuffer(i, np.int64)[places].tobytes())
            index.append(np.frombuffer(x, np.int64).reshape(-1, width)[places].tobytes())
        b = b.set_column(b.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))
        yield b.set_column(b.schema.get_field_index("index"), "index", pa.array(index, pa.binary()))
