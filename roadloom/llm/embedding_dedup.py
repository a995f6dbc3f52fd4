"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.cluster_links import cluster_links
from roadloom.llm.common import by_sorted_groups, out_batches, ranked, rows_in_groups, written
from roadloom.llm.graph import component_ids, components
from roadloom.llm.line_dedup import bloom
from roadloom.llm.vectors import bounded_sample, keyed_rows, unit

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Bits of a sketch, which codes that lie within radius are compared by too.
WIDE = 128
#: Codes that a task holds before it deals them to regions, and pairs of codes that are compared in one step.
PACKED, STEP = 1 << 20, 1 << 21


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 11) -> np.ndarray:
    """A projection: principal directions turned so that their signs lose least (iterative quantisation).

    Signs are taken about the origin, as cosines are: about the mean, a group of copies that holds much of the
    table would draw the mean to itself and lose its own links. Directions beyond the vectors' width are random, so
    short vectors still get codes of `bits` bits.
    """
    rng = np.random.default_rng(seed)
    _, v = np.linalg.eigh(x.T @ x)
    v = v[:, ::-1][:, :bits]
    own = v.shape[1]
    z = x @ v
    turn = np.linalg.qr(rng.normal(size=(own, own)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ w).T
    extra = rng.normal(size=(x.shape[1], bits - own))
    return np.hstack([v @ turn, extra])


def learn_sketch(width: int, seed: int = 12) -> np.ndarray:
    """WIDE directions in turned frames, none of them learned."""
    rng = np.random.default_rng(seed)
    frames = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-WIDE // width))]
    return np.hstack(frames)[:, :WIDE]


def wide_radius(radius: int) -> int:
    """The bits in which sketches may differ where codes of 64 bits may in `radius`."""
    return 2 * radius + 2


def alike(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Where rows (code, sketch ...) are within radius, their sketches too; rows of a code alone have no sketch."""
    near = np.bitwise_count(x[..., 0] ^ y[..., 0]) <= radius
    if x.shape[-1] > 1:
        hit = near.copy()
        p, q = (z[hit] for z in np.broadcast_arrays(x, y))
        near[hit] = np.bitwise_count(p[:, 1:] ^ q[:, 1:]).sum(axis=1, dtype=np.int64) <= wide_radius(radius)
    return near


def hamming_edges(codes: np.ndarray, radius: int, chunk: int = 512, left: np.ndarray | None = None, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect all pairs of codes within radius as those pairs do, at most one for each code.

    One pass joins what lies near the first code; only the others are compared with everything. With left and
    right, only pairs of one from each count.
    """
    root = np.arange(len(codes))
    if left is None:
        near = alike(codes, codes[:1], radius)
        root[near] = 0
        left, right = np.nonzero(~near)[0], np.arange(len(codes))
    for at in range(0, len(left), chunk):
        rows = left[at : at + chunk]
        close = alike(codes[rows][:, None], codes[right][None, :], radius)
        for i in np.nonzero(close.any(axis=1))[0]:
            met = np.append(root[right[close[i]]], root[rows[i]])
            if (met != (least := met.min())).any():
                hit = np.zeros(len(codes), bool)
                hit[met] = True
                root[hit[root]] = least
    return [(int(i), int(root[i])) for i in np.nonzero(root != np.arange(len(codes)))[0]]


def thirds(width: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the three parts of a substring."""
    third = width // 3
    return [(2 * third, width - 2 * third), (third, third), (0, third)]


def region_masks(width: int, part: int) -> list[list[int]]:
    """Bits in which two substrings of a region of this part may differ: up to two.

    Two substrings that differ in so many bits are alike in a part; they count in the region of the first such part.
    """
    at = [next(i for i, (low, n) in enumerate(thirds(width)) if low <= b < low + n) for b in range(width)]
    some = [[], *[[b] for b in range(width)], *[[b, c] for b in range(width) for c in range(b)]]
    return [m for m in some if min(set(range(3)) - {at[b] for b in m}) == part]


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after the edges a - b: root[i] is the smallest place that i reaches."""
    while True:
        x, y = root[a], root[b]
        if not (new := x != y).any():
            return root
        a, b, x, y = a[new], b[new], x[new], y[new]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (above := root[root])).any():
            root = above


def region_edges(codes: np.ndarray, sub: np.ndarray, width: int, part: int, radius: int, live: np.ndarray, crowded: np.ndarray) -> list[tuple[int, ...]]:
    """Edges (code, sketch ..., code, sketch ...) between codes of one region that are within radius and meet under a substring.

    sub: each code's substring. Two meet under a live substring that differs from each of theirs in one bit at most;
    those that meet under a crowded one are left out. At most one edge for each code, which connect as all do.
    """
    if len(codes) < 2:
        return []
    order = np.argsort(sub, kind="stable")
    codes, sub = codes.reshape(len(codes), -1)[order], sub[order]
    code = codes[:, 0].copy()
    own, first, group, own_n = np.unique(sub, return_index=True, return_counts=True, return_inverse=True)
    start, n = np.zeros(1 << width, np.int64), np.zeros(1 << width, np.int64)
    start[own], n[own] = first, own_n
    root, packed = np.arange(len(codes)), live & crowded

    def meet(a, b):
        nonlocal root
        close = np.nonzero(np.bitwise_count(code[a] ^ code[b]) <= radius)[0]
        a, b = a[close], b[close]
        close = alike(codes[a], codes[b], radius)
        root = joined_roots(root, a[close], b[close])

    for bits in region_masks(width, part):
        mask = sum(1 << b for b in bits)
        to = own ^ mask
        if len(bits) < 2:
            ok = ~packed[own] & ~packed[to]
        else:
            x, y = own ^ (1 << bits[0]), own ^ (1 << bits[1])
            ok = (live[x] | live[y]) & ~packed[x] & ~packed[y]
        count = np.where(ok & (own <= to), n[to], 0)
        large = own_n * count >= 4096
        for i in np.nonzero(large)[0].tolist():
            other = codes[start[to[i]] : start[to[i]] + count[i]]
            step = max(1, STEP // len(other))
            for at in range(int(first[i]), int(first[i] + own_n[i]), step):
                mine = codes[at : min(at + step, int(first[i] + own_n[i]))]
                a, b = np.nonzero(alike(mine[:, None], other[None, :], radius))
                root = joined_roots(root, a + at, b + start[to[i]])
        count[large] = 0
        each = count[group]
        some = np.nonzero(each)[0]
        upto = np.cumsum(each[some])
        for at in range(0, int(upto[-1]) if len(upto) else 0, STEP):
            # codes whose pairs begin in this step
            rows = some[np.searchsorted(upto - each[some], at) : np.searchsorted(upto - each[some], at + STEP)]
            if not len(rows):
                continue
            k = each[rows]
            ends = np.cumsum(k)
            meet(np.repeat(rows, k), np.arange(ends[-1]) + np.repeat(start[to[group[rows]]] - (ends - k), k))
    left = np.nonzero(root != np.arange(len(codes)))[0]
    return list(map(tuple, np.hstack([codes[left], codes[root[left]]]).view(np.int64).tolist()))


def named_bits(codes: DataFrame) -> list[str]:
    """The columns of codes (rep, code, sketch ...) that hold bits, the code first."""
    return ["code", *[c for c in codes.columns if c.startswith("wide")]]


def packed_regions(heads: DataFrame, tables: int) -> DataFrame:
    """(region, codes): each code, with its sketch, once for each part of each substring, many in a row.

    A region holds the codes that are alike in one of the three parts of a substring, so codes whose substrings
    differ in up to two bits share one.
    """
    width = 64 // tables
    parts = thirds(width)

    def deal(batches):
        held, n = [], 0
        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).view(np.uint64))
            n += len(held[-1])
            if n >= PACKED:
                yield from flush(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from flush(np.concatenate(held))

    def flush(codes):
        for t in range(tables):
            for part, (low, bits) in enumerate(parts):
                value = ((codes[:, 0] >> np.uint64(width * t + low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                ends = np.cumsum(np.bincount(value, minlength=1 << bits))
                dealt = np.split(codes[np.argsort(value, kind="stable")], ends[:-1])
                some = [i for i, x in enumerate(dealt) if len(x)]
                region = [((t * 3 + part) << 32) + i for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), pa.array([dealt[i].tobytes() for i in some], pa.binary())], names=["region", "codes"])

    return heads.select(*named_bits(heads)).mapInArrow(deal, "region long, codes binary")


def region_pairs(heads: DataFrame, tables: int, radius: int, live: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """Edges (a, b) of codes that meet under a substring that isn't crowded and lie within radius. live, crowded: by table."""
    width, bits = 64 // tables, named_bits(heads)
    ends = [f"{x}_{c}" for x in "ab" for c in bits]
    flags = np.packbits(np.stack([live, crowded]), axis=-1)

    def compare(batches):
        live, crowded = np.unpackbits(flags, axis=-1, count=1 << width).astype(bool)

        def edges():
            for (region,), group in rows_in_groups(batches, ["region"]):
                t, part = divmod(region >> 32, 3)
                codes = np.frombuffer(b"".join(r["codes"] for r in group), np.uint64).reshape(-1, len(bits))
                sub = ((codes[:, 0] >> np.uint64(width * t)) & np.uint64((1 << width) - 1)).astype(np.int64)
                yield from region_edges(codes, sub, width, part, radius, live[t], crowded[t])

        yield from out_batches(edges(), pa.schema([(c, pa.int64()) for c in ends]))

    found = by_sorted_groups(packed_regions(heads, tables), ["region"], [], compare, ", ".join(f"{c} long" for c in ends)).distinct()
    for x in "ab":
        found = found.join(heads.select(*[F.col(c).alias(f"{x}_{c}") for c in bits], F.col("rep").alias(x)), [f"{x}_{c}" for c in bits])
    return found.select("a", "b")


def substring_counts(heads: DataFrame, tables: int) -> np.ndarray:
    """How many codes have each substring, by table: 2 ** (64 / tables) counts for each, whatever the number of codes."""
    width = 64 // tables
    subs = heads.select(F.posexplode(F.array(*[F.shiftrightunsigned("code", width * i).bitwiseAND((1 << width) - 1) for i in range(tables)])).alias("t", "sub"))
    got = written(subs.groupBy("t", "sub").agg(F.count("*").alias("n")), "itq-counts").toArrow()
    out = np.zeros((tables, 1 << width), np.int64)
    out[got["t"].to_numpy(), got["sub"].to_numpy()] = got["n"].to_numpy()
    return out


def bucket_cells(codes: DataFrame, tables: int, radius: int, bucket: int, crowds_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells (t, at, p, q, part, rep, code, sketch ...) of distinct codes to compare, and edges (a, b) found without comparing.

    A code stands under each of its substrings and under every neighbour of one that the table holds. A group of up
    to `bucket` codes is one cell. In a larger one, codes within radius of the group's least code are edges to it; the
    rest is split by a hash of rep into parts of about `bucket`, as are the near ones, and each pair of parts with a
    rest in it is a cell of its own, so no task holds more than two parts whatever the group's size. crowds_only:
    only cells of the larger groups.
    """
    width, own = 64 // tables, ["rep", *named_bits(codes)]
    # substrings are counted in a table of fixed size while they have 16 bits
    fixed = F.broadcast if width <= 16 else (lambda df: df)
    mask = (1 << width) - 1
    subs = codes.select(*own, F.posexplode(F.array(*[F.shiftrightunsigned("code", width * i).bitwiseAND(mask) for i in range(tables)])).alias("t", "sub"))
    probes = F.explode(F.array(F.col("sub"), *[F.col("sub").bitwiseXOR(1 << i) for i in range(width)])).alias("at")
    lived = written(subs.groupBy("t", "sub").agg(F.count("*").alias("n"), F.min(F.struct(*own)).alias("hub")), "itq-lived")
    sizes = lived.select("t", probes, "n").groupBy("t", "at").agg(F.sum("n").alias("n"))
    groups = written(lived.select("t", F.col("sub").alias("at"), "hub").join(sizes, ["t", "at"]).where("n > 1"), "itq-groups")
    met = subs.select("t", probes, *own)
    none = F.lit(0)
    small = met.join(fixed(groups.where(F.col("n") <= bucket).select("t", "at")), ["t", "at"])
    cells = small.select("t", "at", none.alias("p"), none.alias("q"), none.alias("part"), *own)
    crowded = groups.where(F.col("n") > bucket)
    if crowded.isEmpty():
        return cells, cells.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    apart = [F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub.{c}"))) for c in own[1:]]
    near = (apart[0] <= radius) & (sum(apart[1:], F.lit(0)) <= wide_radius(radius))
    large = met.join(fixed(crowded.select("t", "at", "hub")), ["t", "at"]).withColumn("near", near)
    parts = lambda c: F.ceil(F.count_if(c) / bucket).cast("int")
    counts = large.groupBy("t", "at").agg(parts(~F.col("near")).alias("r"), parts(F.col("near")).alias("n")).where("r > 0")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.col(n), F.lit(1))).cast("int")
    # rest parts are 0 to r - 1 and meet all; near ones follow and meet the rest only
    placed = large.join(fixed(counts), ["t", "at"]).withColumn("part", F.when(F.col("near"), F.col("r") + part("n")).otherwise(part("r")))
    placed = placed.withColumn("other", F.explode(F.sequence(none, F.when(F.col("near"), F.col("r") - 1).otherwise(F.col("r") + F.col("n") - 1))))
    split = placed.select("t", "at", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", *own)
    return split if crowds_only else cells.unionByName(split), large.where("near").select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).where("a <> b")


def candidate_edges(codes: DataFrame, tables: int, radius: int, bucket: int) -> DataFrame:
    """Edges (a, b) that connect codes (rep, code, sketch ...) which meet in a table and lie within radius.

    Sketches, columns named wide..., lie within wide_radius() too: of millions of codes each is within radius of some by
    chance, and what connects those would be one cluster of nearly all.

    Codes meet under a substring that one of them holds, each with its own at most one bit away. While substrings have
    16 bits, regions compare those that meet; only groups under a substring of more than `bucket` codes, and of eight
    times the mean, go to bucket_cells(), as do all groups of longer substrings.
    """
    bits = named_bits(codes)
    heads = written(codes.groupBy(*bits).agg(F.min("rep").alias("rep"), F.count("*").alias("n")), "itq-heads")
    equal = codes.select(F.col("rep").alias("a"), *bits).join(heads.where("n > 1"), bits).select("a", F.col("rep").alias("b")).where("a <> b")
    width = 64 // tables
    found = None
    if width <= 16:
        counts = substring_counts(heads, tables)
        at = np.arange(1 << width)
        sizes = counts + sum(counts[:, at ^ (1 << i)] for i in range(width))
        bucket = max(bucket, 8 * int(counts[0].sum()) * (width + 1) >> width)
        crowded = (counts > 0) & (sizes > bucket)
        found = region_pairs(heads, tables, radius, counts > 0, crowded).union(equal)
        if not crowded.any():
            return found
    cells, known = bucket_cells(heads.select("rep", *bits), tables, radius, bucket, found is not None)

    def retrieve(batches):
        def edges():
            for (_, _, p, q), group in rows_in_groups(batches, ["t", "at", "p", "q"]):
                code = np.array([[r[c] for c in bits] for r in group], np.int64).view(np.uint64)
                sides = ()
                if p != q:
                    part = np.array([r["part"] for r in group])
                    sides = np.nonzero(part == p)[0], np.nonzero(part == q)[0]
                for i, j in hamming_edges(code, radius, 512, *sides):
                    yield group[i]["rep"], group[j]["rep"]

        yield from out_batches(edges(), _EDGE)

    return by_sorted_groups(cells, ["t", "at", "p", "q"], [], retrieve, "a long, b long").union(known).union(equal if found is None else found)


def sampled(reps: DataFrame, n: int) -> DataFrame:
    """The rows that bounded_sample() takes; of a large table, only those that may be among them are sorted."""
    total = reps.count()
    if total > 2 * n:
        few = reps.where(F.xxhash64(F.lit(17), "id") <= int(2**64 * 1.5 * n / total) - 2**63)
        if few.count() >= n:
            reps = few
    return bounded_sample(reps, "id", n)


def stacked(items: list[bytes], kind: type) -> np.ndarray:
    """Vectors held as bytes as rows of float64; shorter ones end in zeros."""
    rows = [np.frombuffer(v, kind) for v in items]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def near_dedup_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tables: int = 4, radius: int = 14, sample: int = 20_000, block: int = 512, bucket: int = 2048) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    A rotation for balanced 64-bit codes is learned on `sample` vectors (the documented bound). All codes go
    to `tables` substring tables, each looked up with every substring at distance 0 or 1; codes that meet
    and lie within `radius` bits, and within 2 * radius + 2 of the 128 bits of a sketch, join a candidate cluster; a crowded substring is compared in parts of about `bucket`
    codes. Inside each cluster the original vectors are
    compared in double precision, so a link has cosine >= threshold, and copies count by their number.
    Equal vectors are one representative throughout, known by 128 bits of a hash; vectors are read again where they
    are needed, and only those of candidate clusters travel.

    Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing; vectors of other lengths compare as if ended by zeros; repeated rows are vectors of their own, and so are
    rows of one id with other vectors;
    null ids are dropped (a row without an id can't be reported); an empty table gives no rows; other
    columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    # components that were float stay so where they travel
    kind = np.float32 if vectors.select(F.col(vector_col)).schema[0].dataType.elementType.typeName() == "float" else np.float64

    def keyed(batches):
        for b in batches:
            _, usable, h = keyed_rows(b.column("v"))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(usable)], names=["vec_id", "h1", "h2", "usable"])

    keys = written(rows.mapInArrow(keyed, "vec_id long, h1 long, h2 long, usable boolean"), "itq-keys")
    good = keys.where("usable")
    reps = ranked(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), ["id", "h1", "h2"], "itq-reps")
    asked = {(r.h1, r.h2): i for i, r in enumerate(sampled(reps.select("id", "h1", "h2"), sample).collect())}

    def fetch(batches):
        first, seen = np.array([k[0] for k in asked], np.int64), set()
        for b in batches:
            x, usable, h = keyed_rows(b.column("v"))
            got = []
            for i in np.nonzero(usable & np.isin(h[:, 0], first))[0]:
                place = asked.get((int(h[i, 0]), int(h[i, 1])))
                if place is not None and place not in seen:
                    seen.add(place)
                    got.append((place, x[i].tobytes()))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([v for _, v in got], pa.binary())], names=["place", "item"])

    taken = rows.select("v").mapInArrow(fetch, "place int, item binary").dropDuplicates(["place"]).collect() if asked else []
    fit = unit(stacked([r.item for r in sorted(taken, key=lambda r: r.place)], np.float64) if taken else np.zeros((1, 1)))
    turn = np.hstack([learn_rotation(fit, 64), learn_sketch(fit.shape[1])])

    def encode(batches):
        for b in batches:
            x, usable, h = keyed_rows(b.column("v"))
            x = unit(x[usable])
            w = max(x.shape[1], len(turn))
            t = np.zeros((w, 64 + WIDE))
            t[: len(turn)] = turn
            x = np.pad(x, ((0, 0), (0, w - x.shape[1])))
            bits = np.packbits(x @ t > 0, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[usable, 0], h[usable, 1], *bits.T)], names=["h1", "h2", "code", "wide1", "wide2"])

    coded = rows.select("v").mapInArrow(encode, "h1 long, h2 long, code long, wide1 long, wide2 long").groupBy("h1", "h2").agg(F.min(F.struct("code", "wide1", "wide2")).alias("bits"))
    codes = written(coded.join(reps, ["h1", "h2"]).select("rep", "bits.*"), "itq-codes")
    near = candidate_edges(codes, tables, radius, bucket)
    clusters = components(near, "itq-candidates")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    asking = written(clusters.join(sizes, "component").join(reps, clusters.node == reps.rep).select(F.col("component").alias("cluster"), "size", "rep", "weight", "h1", "h2"), "itq-asking")

    def carry(batches):
        for b in batches:
            x, usable, h = keyed_rows(b.column("v"))
            yield pa.RecordBatch.from_arrays([pa.array(h[usable, 0]), pa.array(h[usable, 1]), pa.array([v.tobytes() for v in x[usable].astype(kind)], pa.binary())], names=["h1", "h2", "item"])

    # only vectors of candidate clusters travel, and each of them once from a task
    carried = rows.select("v").mapInArrow(carry, "h1 long, h2 long, item binary").where(bloom(asking, "h1", F.col("h1"))).groupBy("h1", "h2").agg(F.first("item").alias("item"))
    members = asking.join(carried, ["h1", "h2"]).select("cluster", "size", "rep", "weight", "item")

    def linked(a: list, b: list) -> np.ndarray:
        x, y = unit(stacked(a, kind)), unit(stacked(b, kind))
        w = max(x.shape[1], y.shape[1])
        x, y = (np.pad(z, ((0, 0), (0, w - z.shape[1]))) for z in (x, y))
        return x @ y.T >= threshold

    found = written(cluster_links(members, linked, block), "itq-links")
    joined = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "itq-components")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    named = component_ids(joined, reps)
    state = reps.join(links, "rep", "left").join(named, reps.rep == named.node, "left").select("h1", "h2", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = good.join(state, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(keys.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
