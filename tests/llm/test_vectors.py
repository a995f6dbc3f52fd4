"""Embedding near-dedup and top-k search against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from roadloom.llm import embedding_dedup, topk_search, vectors
from roadloom.llm.graph import components
from roadloom.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"
ODD = [(901, None), (902, []), (903, [0.0] * 8), (904, [1.0, None] + [0.0] * 6), (905, [float("nan")] * 8), (906, [float("inf")] + [1.0] * 7), (907, [1.0])]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7) for i, v in rows], SCHEMA).repartition(3)


def brute_links(rows, threshold=0.95):
    """id -> (links, component), by all pairs."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    out = {i: (0, i) for i, _ in rows}
    comp = {i: i for i in ids}
    for _ in ids:
        new = {i: min([comp[i], *(comp[ids[b]] for b in np.nonzero(near[a])[0])]) for a, i in enumerate(ids)}
        if new == comp:
            break
        comp = new
    return out | {i: (int(near[a].sum()), comp[i]) for a, i in enumerate(ids)}


def clusters(seed=1, n=30, width=8):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        base = r.normal(size=width)
        for _ in range(1 + c % 6):
            rows.append((len(rows), (base + r.normal(size=width) * 0.05).tolist()))
    rows += [(len(rows) + k, rows[3][1]) for k in range(5)]
    return rows


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_near_dedup_same_as_all_pairs(spark):
    rows = clusters() + ODD
    got = embedding_dedup.near_dedup_embeddings(table(spark, rows))
    assert result(got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_near_dedup_whole_table_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = result(QUERIES["op2_embedding_dedup"](spark, sf_dir)), brute_links(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())


def test_near_dedup_of_blocks(spark):
    """One cluster of more vectors than a block, so that parts meet."""
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    rows = [(i, (base + r.normal(size=8) * 0.12).tolist()) for i in range(120)]
    want = brute_links(rows)
    assert result(embedding_dedup.near_dedup_embeddings(table(spark, rows), block=16, radius=40)) == want


def test_crowded_buckets_are_split_and_lose_no_pair(spark):
    """Codes of which most share a substring: no cell holds the bucket, and what meets stays connected."""
    r = np.random.default_rng(6)
    flips = r.random((700, 64)) < np.where(np.arange(64) < 40, 0.03, 0.5)
    codes = np.unique(np.packbits(flips, axis=1, bitorder="little").view(np.uint64)[:, 0])
    n, radius, bucket = len(codes), 8, 50
    subs = [(codes >> np.uint64(16 * t)) & np.uint64(0xFFFF) for t in range(4)]
    met = np.zeros((n, n), bool)
    for s in subs:
        for at in np.unique(s):
            under = np.bitwise_count(s ^ at) <= 1
            met |= under[:, None] & under[None, :]
    near = met & (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius)
    want = np.arange(n)
    while (new := np.where(near, want[None, :], n).min(axis=1)).tolist() != want.tolist():
        want = new
    table_ = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes.view(np.int64))], "rep long, code long")
    cells, _ = embedding_dedup.bucket_cells(table_, 4, radius, bucket)
    largest = max(x["count"] for x in cells.groupBy("t", "at", "p", "q").count().collect())
    assert largest <= 2 * 2 * bucket < max(int((np.bitwise_count(s ^ at) <= 1).sum()) for s in subs for at in np.unique(s))
    for size in (bucket, 10_000):
        got = {x.node: x.component for x in components(embedding_dedup.candidate_edges(table_, 4, radius, size)).collect()}
        assert [got.get(i, i) for i in range(n)] == want.tolist()
    assert 1 < len(set(want.tolist())) < n


@pytest.mark.parametrize("bucket", [20, 10_000])
def test_codes_that_are_near_by_chance_join_no_cluster(spark, bucket):
    """Codes all within radius whose sketches form two groups: two clusters, in crowded groups too."""
    r = np.random.default_rng(9)
    base, wide = (int(x) for x in r.integers(0, 2**63, 2))
    codes = {base} | {base ^ sum(1 << (16 * t + int(b)) for t, b in enumerate(r.integers(0, 16, 4))) for _ in range(300)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    far = (1 << 64) - 1
    rows = [(i, signed(c), signed(wide ^ (far * (i % 2)) ^ (1 << i % 64)), i % 7) for i, c in enumerate(sorted(codes))]
    table_ = spark.createDataFrame(rows, "rep long, code long, wide1 long, wide2 long")
    got = {x.node: x.component for x in components(embedding_dedup.candidate_edges(table_, 4, 14, bucket)).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == [i % 2 for i in range(len(rows))]


def test_codes_travel_twelve_times(spark):
    """Once for each third of each substring, without a row for every neighbour."""
    r = np.random.default_rng(10)
    n = 5000
    table_ = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(r.integers(-(2**63), 2**63, (n, 3)))], "rep long, code long, wide1 long, wide2 long")
    sent = embedding_dedup.packed_regions(table_.coalesce(2), 4).collect()
    assert sum(len(x.codes) for x in sent) == 12 * 24 * n and len(sent) <= 2 * 512
    assert sum(len(embedding_dedup.region_masks(16, p)) for p in range(3)) == 1 + 16 + 120


def test_keys_of_rows():
    """Equal rows have one key whatever a zero's sign; null, empty, zero and non-finite rows aren't usable."""
    rows = [[1.0, 2.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [-0.0, 1.0], [0.0, 1.0], [1.0], [float("-inf"), 1.0]]
    _, usable, h = vectors.keyed_rows(pa.array(rows, pa.list_(pa.float64())))
    assert usable.tolist() == [True, False, False, False, False, False, True, True, True, False]
    assert (h[6] == h[7]).all() and len({tuple(x) for x in h[usable].tolist()}) == 3
    x, usable, _ = vectors.keyed_rows(pa.array([[9.0, 9.0], [3.0, 4.0]], pa.list_(pa.float64())).slice(1))
    assert x.tolist() == [[3.0, 4.0]] and usable.tolist() == [True]


def test_near_dedup_empty(spark):
    assert embedding_dedup.near_dedup_embeddings(table(spark, [])).count() == 0


def brute_top(rows, every, k):
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for q, x in good:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k,block,groups", [(3, 4, 2), (20, 256, 64), (200, 8, 3)])
def test_top_k_same_as_brute_force(spark, k, block, groups):
    rows = clusters() + ODD
    got = topk_search.top_k(table(spark, rows), every=5, k=k, block_rows=block, group_blocks=groups, chunk=7)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 5, k)


def test_top_k_ties_and_empty(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)]
    got = topk_search.top_k(table(spark, rows), block_rows=4)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 20, 20)
    assert topk_search.top_k(table(spark, [])).count() == 0


def test_top_k_of_large_components(spark):
    """Scores between 53 and 64 bits are exact, bounds beyond 64 bits prune nothing wrongly, larger scores raise."""
    r = np.random.default_rng(8)
    scaled = lambda scale, n, width: [(i, (r.integers(-12, 13, width) * scale).tolist()) for i in range(n)]
    schema = "vec_id long, embedding array<double>"
    for scale in (2.0**17, 2.0**20):
        rows = scaled(scale, 60, 6) + [(60, [scale])]
        got = topk_search.top_k(spark.createDataFrame(rows, schema), every=5, k=4, block_rows=8)
        x = {i: [int(64 * c) for c in v] for i, v in rows}
        want = []
        for q in range(0, 61, 5):
            top = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(top)]
        assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got.collect()) == sorted(want)
        assert max(s for *_, s in want) > 2**53
    for huge in (1e12, 1e300):
        with pytest.raises(Exception, match="64 bits"):
            topk_search.top_k(spark.createDataFrame([(i, [huge, huge]) for i in range(6)], schema), every=5, k=2).collect()


def test_top_k_bounds_beyond_64_bits():
    q, most = np.array([[2**31, 2**31, -(2**31)]]), np.array([[2**31] * 3])
    assert topk_search.block_bounds(q, most, -most).tolist() == [[2**63 - 1]]


def test_top_k_same_as_sql(spark, sf_dir, duck, same_rows):
    assert same_rows(QUERIES["op4_topk_search"](spark, sf_dir), duck, ORACLE["op4_topk_search"])


def test_one_id_on_two_vectors(spark):
    """Both vectors of an id keep their links; null ids go."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(5, a), (5, b), (6, [1.0, 0.1, 0.0, 0.0]), (7, [0.1, 1.0, 0.0, 0.0]), (3, [0.1, 1.0, 0.0, 0.01]), (None, a), (9, [0.0, 0.0, 0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_dedup_embeddings(table(spark, rows)).collect())
    assert got == [(3, 2, 3, True), (5, 1, 5, True), (5, 2, 3, False), (6, 1, 5, False), (7, 2, 3, False), (9, 0, 9, True)]


def test_top_k_of_one_id_with_two_vectors(spark):
    """Each vector of an id has its own list; a repeated row answers once."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(20, a), (20, b), (20, b), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (2, [0.1, 0.9]), (None, a)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(table(spark, rows), k=2).collect())
    assert got == sorted([(20, 1, 1, 57 * 64), (20, 2, 2, 6 * 64), (20, 1, 2, 57 * 64), (20, 2, 2, 57 * 64)])
