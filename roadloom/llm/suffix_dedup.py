"""Repeated passages by a sparse suffix array over minimiser positions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import forget, out_batches, partitions, window_hashes, word_hashes, written

#: Keys that more than one row in so many holds are joined by a broadcast of them: there can be no more than this.
HOT_KEYS = 1000
_WORD = re.compile(r"\S+")
_SEED = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
_SUFFIX = pa.schema([("key", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc", pa.int64()), ("pos", pa.int32()), ("leads", pa.int64())])
_MATCH = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("other", pa.int64())])


def minimisers(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the smallest hash in each run of `window` grams, the leftmost of equals.

    Also the least and most grams by which the runs that choose a place start before it.
    """
    if len(grams) <= window:
        at = np.array([int(grams.argmin())] if len(grams) else [], np.int64)
        return at, at, at
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    chosen = np.concatenate([np.arange(at, at + len(v)) + v.argmin(axis=1) for at in range(0, len(views), 1 << 16) for v in (views[at : at + (1 << 16)],)])
    places, first, n = np.unique(chosen, return_index=True, return_counts=True)
    return places, places - first - n + 1, places - first


def bits(low: int, high: int) -> int:
    """A number with the bits low to high set."""
    return (1 << (high + 1)) - (1 << max(low, 0)) if high >= max(low, 0) else 0


def short_hashes(text: str) -> np.ndarray:
    """A 32-bit hash for each word, big-endian so that bytes compare as numbers."""
    return (word_hashes(_WORD.findall(text)) >> np.uint64(32)).astype(">u4")


def common_start(a: bytes, b: bytes) -> int:
    """Words at the start of both."""
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (8 * n - apart.bit_length()) // 32


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, gram: int = 8, window: int = 28, neighbours: int = 3) -> DataFrame:
    """Passages of at least least_words words that also stand elsewhere: doc_id, start_word, n_words, other_doc_id.

    Suffixes are kept at minimisers of word grams, so two copies of a passage keep the same ones. Suffixes that
    share no start with another go first. The rest is sorted by content and compared with its neighbours:
    matches extend right along the suffix and left before it, and count from least_words words. Sorting is one
    range sort, so a passage that a third of all documents hold is spread over tasks; neighbours across task
    ends are compared as well, in one task that gets 2 * neighbours rows of each. Each suffix carries least_words words to either side; longer passages are the
    union of their suffixes' matches. other_doc_id is one document (or the same) that holds it too.
    Among more than neighbours + 1 suffixes of one start, two that agree most on the left may not be neighbours.
    There the passages of least_words words around a suffix that neighbours leave open, and that could stand
    elsewhere by the suffix's longest match to the right, are looked up by a 128-bit hash of the whole passage, so none is lost.
    Texts that are equal throughout are one representative; its copies get its spans and name each other.

    A passage of L >= least_words words has a minimiser within its first `window` grams, and at least
    least_words - window + 1 words follow it, which must cover a gram: gram + window <= least_words + 1.

    Defined cases: null and short texts have no passages; repeats inside one document count; words are runs of
    non-space, case matters; repeated rows are copies; null ids are dropped; an empty table gives no rows;
    other columns are ignored.
    """
    if gram + window > least_words + 1:
        raise ValueError("gram + window must not exceed least_words + 1")
    shared = least_words - window + 1  # words right of the first minimiser in a passage
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    hashed = base.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    copies = written(hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "suffix-texts")

    def seeds(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                doc, key, pos, low, high = [], [], [], [], []
                for d, t, h1, h2 in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "h1", "h2"))):
                    w = word_hashes(_WORD.findall(t))
                    if len(w) < least_words:
                        continue
                    places, least, most = minimisers(window_hashes(w, gram), window)
                    starts = window_hashes(w, shared)
                    use = places < len(starts)
                    doc.append(np.full(int(use.sum()), d))
                    key.append(starts[places[use]].view(np.int64))
                    for held, x in ((pos, places), (low, least), (high, most)):
                        held.append(x[use].astype(np.int32))
                    # a text's words, under its hashes
                    for held, x, kind in ((doc, h1, np.int64), (key, h2, np.int64), (pos, len(w), np.int32), (low, -1, np.int32), (high, -1, np.int32)):
                        held.append(np.array([x], kind))
                if doc:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (doc, key, pos, low, high)], schema=_SEED)

    found = written(base.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).mapInArrow(seeds, "doc long, key long, pos int, low int, high int"), "suffix-seeds")
    words = written(found.where("low < 0").groupBy(F.col("doc").alias("h1"), F.col("key").alias("h2")).agg(F.max("pos").alias("words")), "suffix-words")
    one_each = written(found.where("low >= 0").join(copies.select("doc"), "doc", "left_semi"), "suffix-one-each")
    forget(found)
    often = written(one_each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "suffix-often")
    # a thousand keys at most hold more than a thousandth of the rows each; only these are broadcast, the rest is even
    most = one_each.count() // HOT_KEYS
    hot, crowd = F.broadcast(often.where(F.col("n") > most)), F.col("n") > neighbours + 1
    even = one_each.join(hot.select("key"), "key", "left_anti").join(often.where(F.col("n") <= most), "key")
    held = one_each.join(hot, "key").unionByName(even)
    # leads: how many words before the suffix its passages may start, as bits; only where neighbours may not be enough
    lead = F.when(crowd, F.col("high") * 64 + F.col("low")).otherwise(-1)
    alive = held.groupBy("doc").agg(F.collect_set(F.struct("pos", lead.alias("lead"))).alias("places"))
    texts = base.withColumnRenamed("doc_id", "doc").join(alive, "doc")

    def suffixes(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = []
                for d, t, places in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "places"))):
                    words = _WORD.findall(t)
                    long_, w = word_hashes(words), short_hashes(t)
                    starts = window_hashes(long_, shared).view(np.int64)
                    for p, lead in sorted((x["pos"], x["lead"]) for x in places if x["pos"] < len(starts)):
                        leads = 0 if lead < 0 else bits(max(lead % 64, least_words + p - len(w)), min(lead // 64, p))
                        rows.append((int(starts[p]), w[p : p + least_words].tobytes(), w[max(0, p - least_words) : p][::-1].tobytes(), d, p, leads))
                yield from out_batches(rows, _SUFFIX)

    # written first, as finding the ranges reads the rows once more than sorting them
    rows_ = written(texts.mapInArrow(suffixes, "key long, right binary, left binary, doc long, pos int, leads long"), "suffix-rows")
    forget(one_each, often)
    ordered = rows_.repartitionByRange(partitions(docs.sparkSession), "key", "right", "left", "doc", "pos").sortWithinPartitions("key", "right", "left", "doc", "pos")

    def compare(batches):
        def rows():
            window_: list[dict] = []
            first: list[dict] = []
            for b in batches:
                for r in b.to_pylist():
                    # known: leads of passages that a neighbour shares; before: that an earlier one shares
                    r |= {"known": 0, "before": 0, "reach": 0 if first else least_words, "back": 0, "on": 0, "other": None}
                    if len(first) < neighbours:
                        first.append(r)
                    for k, o in enumerate(reversed(window_)):
                        pair(o, r, k == 0)
                    window_.append(r)
                    if len(window_) > neighbours:
                        yield from told(window_.pop(0))
            if window_:
                window_[-1]["reach"] = least_words
            for r in window_:
                yield from told(r)
            # the ends of a task, for the comparison across tasks
            for r in first + [r for r in window_ if r not in first]:
                yield None, None, None, None, r["key"], r["right"], r["left"], r["doc"], r["pos"], None, None

        yield from out_batches(rows(), _BOTH)

    def pair(o, r, adjacent=False):
        """Note on both suffixes how far they match; a suffix's matches all hold its place, so their union is one span."""
        if o["key"] != r["key"] or (o["doc"], o["pos"]) == (r["doc"], r["pos"]):
            return
        right, left = common_start(o["right"], r["right"]), common_start(o["left"], r["left"])
        if adjacent:
            o["reach"], r["reach"] = max(o["reach"], right), max(r["reach"], right)
        if right + left >= least_words:
            if o["leads"] or r["leads"]:
                both = bits(least_words - right, left)
                o["known"] |= both
                r["known"] |= both
                r["before"] |= both
            for x, y in ((o, r), (r, o)):
                x["back"], x["on"] = max(x["back"], left), max(x["on"], right)
                x["other"] = y["doc"] if x["other"] is None else min(x["other"], y["doc"])

    def told(r):
        if r["other"] is not None:
            yield r["doc"], r["pos"] - r["back"], r["pos"] + r["on"], r["other"], None, None, None, None, None, None, None
        if r["leads"]:
            yield from passages(r)

    def passages(r):
        """Hashes of a suffix's open passages, and of known ones by the first of those that share them."""
        open_ = r["leads"] & ~r["known"] & bits(least_words - r["reach"], least_words)
        fresh = r["leads"] & r["known"] & ~r["before"]
        for j in range((open_ | fresh).bit_length()):
            if (open_ | fresh) >> j & 1:
                h = xxhash.xxh3_128_digest(np.frombuffer(r["left"], ">u4", j)[::-1].tobytes() + r["right"][: 4 * (least_words - j)])
                yield r["doc"], r["pos"] - j, r["pos"] - j + least_words, None, None, None, None, None, None, h, bool(open_ >> j & 1)

    met = written(ordered.mapInArrow(compare, "doc long, start int, stop int, other long, key long, right binary, left binary, at_doc long, at_pos int, passage binary, open boolean"), "suffix-matches")
    forget(rows_)

    def across(batches):
        def rows():
            window_: list[dict] = []
            for b in batches:
                for r in b.to_pylist():
                    r |= {"leads": 0, "known": 0, "before": 0, "reach": 0, "back": 0, "on": 0, "other": None}
                    for o in window_:
                        pair(o, r)
                    window_.append(r)
                    if len(window_) > 2 * neighbours + 1:
                        yield from (m[:4] for m in told(window_.pop(0)))
            for r in window_:
                yield from (m[:4] for m in told(r))

        yield from out_batches(rows(), _MATCH)

    # 2 * neighbours rows of each task at most; in one task, in the same order
    ends = met.where("key is not null").select("key", "right", "left", F.col("at_doc").alias("doc"), F.col("at_pos").alias("pos")).coalesce(1).sortWithinPartitions("key", "right", "left", "doc", "pos").mapInArrow(across, "doc long, start int, stop int, other long")
    looked = met.where("passage is not null").select("passage", "open", "doc", "start", "stop")
    twice = looked.groupBy("passage").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most")).where("n > 1")
    opened = looked.where("open").join(twice, "passage").select("doc", "start", "stop", F.when(F.col("doc") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("other"))
    matches = met.where("other is not null").select("doc", "start", "stop", "other").union(ends).union(opened)

    # union of overlapping spans: a span starts where nothing before it reaches
    spans = written(matches.groupBy("doc", "start").agg(F.max("stop").alias("stop"), F.min("other").alias("other")), "suffix-spans")
    forget(met)
    merged = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "other"))).alias("s")).select("doc", F.explode(_merge_spans(F.col("s"))).alias("m")).select("doc", "m.*")
    whole = copies.where("n > 1").join(words, ["h1", "h2"])
    alone = merged.join(whole.select("doc"), "doc", "left_anti").select("doc", "start", "stop", "other")
    out = alone.select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("other").alias("other_doc_id"))
    members = hashed.select("doc_id", "h1", "h2").join(whole, ["h1", "h2"])
    every = members.select("doc_id", F.lit(0).alias("start_word"), F.col("words").alias("n_words"), F.when(F.col("doc_id") == F.col("doc"), F.col("last")).otherwise(F.col("doc")).alias("other_doc_id"))
    return out.unionByName(every)


_BOTH = pa.schema([*_MATCH, ("key", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("at_doc", pa.int64()), ("at_pos", pa.int32()), ("passage", pa.binary()), ("open", pa.bool_())])


def _merge_spans(spans):
    """Overlapping or touching (start, stop, other) spans of one document, in order, as their unions."""
    start = F.array().cast("array<struct<start:int,stop:int,other:bigint>>")
    last = lambda acc: F.element_at(acc, -1)

    def step(acc, s):
        joins = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(-1)) >= s["start"])
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], s["stop"]).alias("stop"), F.least(F.try_element_at(acc, F.lit(-1))["other"], s["other"]).alias("other"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["other"].alias("other")))))

    return F.aggregate(spans, start, step)
