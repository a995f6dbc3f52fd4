"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import forget, private, written

#: A hash of 64 bits is cut into this many ranges to find a threshold without sorting a source.
RANGES = 4096
#: The patterns and sources go to the driver for the flow; more than this raises an error.
MOST_PATTERNS = 20_000


def source_targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> dict[str | None, float]:
    """Targets that share the sum of all sizes: weights repeat over the sources by code point, null last.

    A target stops at cap times its source's size; the excess is shared again by weight until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > cap * sizes[s]}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def min_cost_flow(supply: dict, quota: dict, costs: Sequence[int]) -> dict:
    """Words that each (pattern, source) carries: as much of every quota as fits, at least repetition cost.

    supply: pattern (a tuple of its sources) -> words of one reading. Reading a pattern once, twice, ... costs
    costs[0], costs[1], ... a word; costs must not fall. Potentials come from shortest paths; as costs are few, so are
    their distances, and for each of these all paths of that cost are filled together, level by level.
    """
    start, end = ("start",), ("end",)
    edges: list[list] = []  # to, room, cost
    out: dict = {}

    def add(u, v, room, cost):
        out.setdefault(u, []).append(len(edges))
        edges.append([v, room, cost])
        out.setdefault(v, []).append(len(edges))
        edges.append([u, 0, -cost])

    for p, words in supply.items():
        for cost in costs:
            add(start, ("p", p), words, cost)
        for s in p:
            add(("p", p), ("s", s), words * len(costs), 0)
    for s, words in quota.items():
        add(("s", s), end, words, 0)
    potential = dict.fromkeys(out, 0)
    while True:
        far, heap, tick = {start: 0}, [(0, 0, start)], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out.get(u, ()):
                v, room, cost = edges[e]
                if room > 0 and (nd := d + cost + potential[u] - potential[v]) < far.get(v, float("inf")):
                    far[v], tick = nd, tick + 1
                    heapq.heappush(heap, (nd, tick, v))
        if end not in far:
            break
        for u in potential:
            potential[u] += min(far.get(u, far[end]), far[end])
        while _blocked(out, edges, potential, start, end):
            pass
    flow = {}
    for p in supply:
        for e in out[("p", p)]:
            to = edges[e][0]
            if e % 2 == 0 and to[0] == "s" and edges[e ^ 1][1]:
                flow[p, to[1]] = flow.get((p, to[1]), 0) + edges[e ^ 1][1]
    return flow


def _blocked(out: dict, edges: list[list], potential: dict, start: tuple, end: tuple) -> bool:
    """Fill the fewest-edged paths whose edges cost nothing beside the potentials; False if there is none."""
    level, wave = {start: 0}, [start]
    while wave and end not in level:
        after = []
        for u in wave:
            for e in out.get(u, ()):
                v, room, cost = edges[e]
                if room > 0 and v not in level and cost + potential[u] == potential[v]:
                    level[v] = level[u] + 1
                    after.append(v)
        wave = after
    if end not in level:
        return False
    at, path, u = dict.fromkeys(level, 0), [], start
    while True:
        if u == end:
            room = min(edges[e][1] for e in path)
            for e in path:
                edges[e][1] -= room
                edges[e ^ 1][1] += room
            full = next(i for i, e in enumerate(path) if not edges[e][1])
            u = edges[path[full] ^ 1][0]
            del path[full:]
            continue
        own = out[u]
        while at[u] < len(own):
            v, room, cost = edges[own[at[u]]]
            if room > 0 and level.get(v) == level[u] + 1 and cost + potential[u] == potential[v]:
                break
            at[u] += 1
        if at[u] < len(own):
            path.append(own[at[u]])
            u = v
        elif not path:
            return True
        else:
            u = edges[path.pop() ^ 1][0]
            at[u] += 1


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _chosen(keys: DataFrame, want: DataFrame) -> DataFrame:
    """For each pattern: the hash up to which documents in hash order fit into `room`.

    keys (pattern, h, size); want (pattern, room, low, most): only h >= low and size <= most count.
    Returns (pattern, high, filled): the first hash that no longer fits, and the words before it. Sums of hash
    ranges are compared first, so only one range of a pattern is ever sorted.
    """
    own = keys.join(F.broadcast(want), "pattern").where("h >= low and size <= most and size > 0")
    ranged = own.withColumn("range", F.expr("cast((h >> 52) as int)"))
    sums = ranged.groupBy("pattern", "room", "range").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern").orderBy("range")
    sums = sums.withColumn("after", F.sum("words").over(run))
    edge = sums.where("after > room").groupBy("pattern").agg(F.min(F.struct("range", (F.col("after") - F.col("words")).alias("before"))).alias("e")).select("pattern", "e.range", "e.before")
    at = ranged.join(F.broadcast(edge), ["pattern", "range"])
    one = at.groupBy("pattern", "room", "before", "h").agg(F.sum("size").alias("words"))
    one = one.withColumn("after", F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("h")))
    first = one.where("after > room").groupBy("pattern").agg(F.min(F.struct("h", (F.col("after") - F.col("words")).alias("filled"))).alias("f")).select("pattern", F.col("f.h").alias("high"), "f.filled")
    whole = sums.groupBy("pattern", "room").agg(F.sum("words").alias("all")).where("all <= room").select("pattern", F.lit(2**63 - 1).alias("high"), F.col("all").alias("filled"))
    return first.union(whole)


def _plan(docs: DataFrame, m: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, costs: Sequence[int] = (0, 1, 3), seed: int = 7, rounds: int = 4) -> DataFrame:
    """docs with size, source_size, target and times under names that begin with m."""
    spark = docs.sparkSession
    kind = docs.schema[source_col].dataType.typeName()
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(f"`{source_col}`"), F.array(F.lit(None).cast("string"))))) if kind == "array" else F.array(F.col(f"`{source_col}`"))
    h = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    mark = lambda df: df.withColumns({f"{m}pattern": pattern, f"{m}size": word_count(F.col(f"`{text_col}`")), f"{m}h": h})
    keys = written(mark(docs).select(F.col(f"{m}pattern").alias("pattern"), F.col(f"{m}h").alias("h"), F.col(f"{m}size").alias("size")), "mix-keys")
    found = keys.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    supply = {tuple(r.pattern): int(r.words) for r in found}
    sizes: dict = {}
    for p, words in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes, weights, cap)
    flow = min_cost_flow(supply, {s: round(t) for s, t in targets.items()}, costs)
    plan = []
    for p, words in supply.items():
        want = sum(flow.get((p, s), 0) for s in p)
        base = min(len(costs), want // words) if words else 0
        room = want - base * words if base < len(costs) else 0
        plan.append((list(p), base, room))
    per_pattern = {tuple(p): [base, room, []] for p, base, room in plan}
    ask = [(list(p), v[1], -(2**63), 2**62) for p, v in per_pattern.items() if v[1] > 0]
    for _ in range(rounds):
        if not ask:
            break
        want = spark.createDataFrame(ask, "pattern array<string>, room long, low long, most long")
        # ranges of the first round are whole; the gap left is filled by smaller documents behind it
        got = {tuple(r.pattern): r for r in _chosen(keys, want).collect()}
        ask = [_next(p, room, low, most, got.get(tuple(p)), per_pattern) for p, room, low, most in ask]
        ask = [a for a in ask if a]
    table = spark.createDataFrame([(list(p), sum(sizes[s] for s in p), float(sum(targets[s] for s in p)), v[0], v[2]) for p, v in per_pattern.items()] or [([], 0, 0.0, 0, [])], f"{m}pattern array<string>, {m}source_size long, {m}target double, {m}base int, {m}cuts array<struct<low:long,high:long,most:long>>")
    forget(keys)
    size = F.col(f"{m}size")
    out = mark(docs).join(F.broadcast(table), f"{m}pattern")
    extra = F.exists(f"{m}cuts", lambda c: (F.col(f"{m}h") >= c["low"]) & (F.col(f"{m}h") < c["high"]) & (size <= c["most"]))
    times = F.when(size == 0, 0).otherwise(F.col(f"{m}base") + F.when(extra, 1).otherwise(0))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], size, f"{m}source_size", f"{m}target", times.cast("int").alias(f"{m}times"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """docs with _size, _source_size, _target and _times (how often the mix reads the document).

    source_col is a string, or an array of strings where documents belong to several sources. Documents are
    aggregated by membership pattern; a min-cost flow routes pattern words to source targets with
    costs that rise with each repetition (len(costs) readings at most). A pattern's whole readings go to all its
    documents; the remainder goes to documents in the order of a seeded hash of id, text and size, and the
    last gap is filled from the documents that still fit, `rounds` times. Whole documents only.

    Decisions are a few thresholds for each pattern, so the documents themselves are never shuffled. Patterns
    are small configuration-like sets: more than MOST_PATTERNS raises an error.

    Defined cases: null text has size 0 and is never read; a null source is a source of its own, last in
    order; repeated rows share their fate; an empty table gives no rows; other columns stay as they
    are, but the four columns replace columns of their names.
    """
    m, names = private(*docs.columns), ("size", "source_size", "target", "times")
    made = _plan(docs, m, **options)
    return made.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {f"_{n}" for n in names}], *[F.col(f"{m}{n}").alias(f"_{n}") for n in names])


def _next(p, room, low, most, got, per_pattern):
    """Note what a round chose for a pattern; what the next round asks for, if anything is left to fill."""
    if got is None:
        return None
    per_pattern[tuple(p)][2].append((low, got.high, most))
    left = room - got.filled
    return (p, left, got.high, left) if left > 0 and got.high < 2**63 - 1 else None


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (size times how often the mix reads it).

    Defined cases: as mix_plan(); null ids and repeated rows get a row each.
    """
    m = private(*docs.columns)
    made = _plan(docs, m, id_col=id_col, **options)
    return made.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"{m}{n}").alias(n) for n in ("size", "source_size", "target")], (F.col(f"{m}size") * F.col(f"{m}times")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as the mix reads it.

    Defined cases: as mix_plan(); texts without words, null ones too, are never read; columns of any name stay.
    """
    m = private(*docs.columns)
    made = _plan(docs, m, **options).where(F.col(f"{m}times") > 0)
    return made.withColumn(f"{m}copy", F.explode(F.sequence(F.lit(1), F.col(f"{m}times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
