"""Language-model scores by a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import forget, id_crc32, mix64, out_batches, partitions, rows_in_groups, settings, written

#: The hash of the end of a text; no word is empty.
END = np.uint64(xxhash.xxh64_intdigest(b""))
#: Spark's bound of an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Keys that a part of an exchange holds, about.
PART = 1 << 21
#: Gains are added up in so many parts of a nat.
STEPS = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOKENS = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("docs", pa.list_(pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("size", pa.int64()), ("lead", pa.int32())]))), ("trained", pa.int64()), ("tokens", pa.int64())])
_TOKENS_SQL = "block long, words binary, ids binary, docs array<struct<row:long,doc_id:long,held:boolean,size:long,lead:int>>, trained long, tokens long"
_ASKED = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("given", pa.binary())])
_ASKED_SQL = "block long, part long, keys binary, given binary"
_TOTAL = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("totals", pa.binary()), ("seen", pa.int64())])
_SCORES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed, so that small ones take little room."""
    width = x.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes())


def _from_planes(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _keys_packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, whose first bytes are mostly zero."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys_unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, "<u8"), dtype=np.uint64)


def word_arrays(texts: pa.Array) -> list[np.ndarray]:
    """For each text the hashes of its words, A-Z lower-cased, parted by ASCII white space, then END."""
    whole = texts.take(pa.array(np.arange(len(texts))))  # splitting a slice of an array goes wrong: it reads past its offset
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole.cast(pa.large_string()).fill_null("")))
    words = split.values.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in words.dictionary], np.uint64)
    tokens = hashes[words.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.empty(0, np.uint64)
    at = split.offsets.to_numpy()
    out = []
    for i in range(len(texts)):
        w = tokens[at[i] : at[i + 1]]
        out.append(np.append(w[w != END], END))  # white space at the ends parts off an empty word
    return out


def tokenised(base: DataFrame, depth: int, block_tokens: int) -> DataFrame:
    """Blocks of about block_tokens tokens: sorted hashes of their words, tokens as places among these, texts.

    A long text is cut into pieces; each but the first begins with `lead` tokens of the piece before, as context only.
    """

    def cut(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32

        def pieces():
            for b in batches:
                sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
                at = 0
                while at < b.num_rows:  # some megabytes of text at a time
                    to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (8 << 20), "right")))
                    part = b.slice(at, to - at)
                    for row, doc, held, w in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), part.column("held").to_pylist(), word_arrays(part.column("text"))):
                        for start in range(0, len(w), block_tokens):
                            lead = min(start, depth)
                            yield (row, doc, held, len(w[start : start + block_tokens]) + lead, lead), w[start - lead : start + block_tokens]
                    at = to

        def blocks():
            n, held, docs, size = 0, [], [], 0
            for doc, w in pieces():
                if held and size + len(w) > block_tokens:
                    yield close(first + n, held, docs)
                    n, held, docs, size = n + 1, [], [], 0
                held.append(w)
                docs.append(doc)
                size += len(w)
            if held:
                yield close(first + n, held, docs)

        def close(block, held, docs):
            words, ids = np.unique(np.concatenate(held), return_inverse=True)
            own = [d[3] - d[4] for d in docs]
            docs = [dict(zip(("row", "doc_id", "held", "size", "lead"), d)) for d in docs]
            return block, _keys_packed(words), _planes(ids.astype("<i4")), docs, sum(n for n, d in zip(own, docs) if not d["held"]), sum(own)

        yield from out_batches(blocks(), _TOKENS, 4)

    return written(base.mapInArrow(cut, _TOKENS_SQL), "pst-tokens")


class Block:
    """A block's tokens with what is known of them."""

    def __init__(self, r: dict):
        self.block, self.docs = r["block"], r["docs"]
        self.words, self.ids = _keys_unpacked(r["words"]), _from_planes(r["ids"], "<i4")
        sizes = np.array([d["size"] for d in self.docs], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.place = np.arange(len(self.ids)) - np.repeat(self.starts, sizes)
        self.own = self.place >= np.repeat([d["lead"] for d in self.docs], sizes)
        #: 1 for the tokens that are learned from
        self.given = self.own & ~np.repeat([d["held"] for d in self.docs], sizes)

    def levels(self, totals: list[np.ndarray], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Level by level (places, keys, inverse, counts): of the tokens at these places the strings of k words before them
        and themselves, as sorted distinct keys with the place among these of each, and how often training holds them.

        Level k has the tokens whose k words before them stand in training `least` times or more. The last level is
        that whose totals aren't known yet; it has no counts.
        """
        gram = self.words[self.ids]
        below = totals[0][self.ids] if totals else None
        yield np.arange(len(self.ids)), self.words, self.ids, below
        for k in range(1, len(totals) + 1):
            ok = self.place >= k
            ok[1:] &= below[:-1] >= least
            at = np.nonzero(ok)[0]
            gram = gram.copy()
            gram[at] = mix64(gram[at] * _STEP + self.words[self.ids[at - k]])
            keys, inverse = np.unique(gram[at], return_inverse=True)
            if k == len(totals):
                yield at, keys, inverse, None
                return
            below = np.zeros(len(self.ids), np.int64)
            below[at] = totals[k][inverse]
            yield at, keys, inverse, below[at]


def _packed(values: np.ndarray) -> bytes:
    """Counts in as few bytes as they need, compressed; the first byte says how many."""
    size = 1 if not len(values) or values.max() < 256 else 2 if values.max() < 65_536 else 4 if values.max() < 2**32 else 8
    return bytes([size]) + _planes(values.astype(f"u{size}"))


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([_from_planes(b[1:], f"u{b[0]}").astype(np.int64) for b in blobs] or [np.empty(0, np.int64)])


def _asks(block: int, keys: np.ndarray, given: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows (block, part, keys, given) of sorted keys: a part is the keys of some first bits."""
    parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.concatenate([[0], np.nonzero(np.diff(parts))[0] + 1, [len(keys)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield block, int(parts[a]), _keys_packed(keys[a:b]), _planes(given[a:b])


def _whole(gains: np.ndarray) -> np.ndarray:
    """Gains as whole numbers of 1 / STEPS nats, the sign in the last bit: their sums don't depend on any order."""
    n = np.rint(gains * STEPS).astype(np.int64)
    return ((n << 1) ^ (n >> 63)).view(np.uint64)


def _signed(n: np.ndarray) -> np.ndarray:
    return (n >> np.uint64(1)).view(np.int64) ^ -(n & np.uint64(1)).view(np.int64)


def _exchanged(asked: DataFrame, name: str, gain: float | None = None) -> DataFrame:
    """For the keys that blocks ask, what all blocks give to them, summed: one row a block, its parts in order.

    Keys travel as compressed stretches, which numpy sums in the task of their part. Counts are given, or with `gain` gains;
    of these the answer is only whether their sum is at least that many nats.
    """

    def total(batches):
        def rows():
            for (part,), group in rows_in_groups(batches, ["part"]):
                keys = [_keys_unpacked(r["keys"]) for r in group]
                sizes = [len(k) for k in keys]
                given = np.concatenate([_from_planes(r["given"], "<u4") if gain is None else _signed(_from_planes(r["given"], "<u8")) for r in group])
                distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                sums = np.bincount(inverse, weights=given, minlength=len(distinct))
                sums = sums.astype(np.int64) if gain is None else (sums >= gain * STEPS).astype(np.int64)
                seen, at = int((sums > 0).sum()), 0
                for r, n in zip(group, sizes):
                    yield r["block"], part, _packed(sums[inverse[at : at + n]]), seen
                    seen, at = 0, at + n

        yield from out_batches(rows(), _TOTAL, 256)

    spread = asked.repartition(partitions(asked.sparkSession), "part").sortWithinPartitions("part", "block")
    return written(spread.mapInArrow(total, "block long, part long, totals binary, seen long"), name)


def _known(tokens: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks of tokens with the answers to each level, as array columns t0, t1, ..."""
    out = tokens
    for i, a in enumerate(answers):
        stretches = a.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "totals"))).alias("s"))
        out = out.join(stretches.select("block", F.col("s.totals").alias(f"t{i}")), "block", "left")
    return out


def _rows(batches) -> Iterator[tuple[Block, list[np.ndarray]]]:
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            answers = [_unpacked(r[c] or []) for c in sorted((c for c in r if c[0] == "t" and c[1:].isdigit()), key=lambda c: int(c[1:]))]
            yield Block(r), answers


def _chances(block: Block, totals: list[np.ndarray], least: int, n: float, v: float, weight: float, without: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level (places, chance of the token after the context of that length, the context's key).

    Each level adds `weight` tokens, shared out as the level below has it, to what stands after the context. With
    without=1 a token's own place is left out of all counts.
    """
    chance, before, gram = None, None, None
    for k, (at, keys, inverse, counts) in enumerate(block.levels(totals, least)):
        if counts is None:
            return
        if k == 0:
            chance = (counts + 1 - without) / max(1, n - without + v + 1)
            before, gram = counts, keys[inverse]
            yield at, chance, np.empty(0, np.uint64)
            continue
        times = before[at - 1]
        made = (counts - without + weight * chance[at]) / (times - without + weight)
        context = gram[at - 1]
        chance = chance.copy()
        chance[at] = made
        before, gram = np.zeros_like(before), np.zeros_like(gram)
        before[at], gram[at] = counts, keys[inverse]
        yield at, made, context


def held_out_of(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    """True where the crc32 of the id as text has this remainder; null ids are read as empty text."""
    return F.pmod(F.coalesce(id_crc32(F.col(f"`{id_col}`")), F.lit(0)), F.lit(folds)) == fold


def score_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, depth: int = 2, least: int = 4,
    weight: float = 300.0, gain: float = 10.0, block_tokens: int = 1 << 19,
) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's chance).

    Tokens are a text's words, A-Z lower-cased, and one end. The tree has contexts of up to `depth` words that stand
    in training texts `least` times or more. After a context the chance of a token is its count, with `weight` tokens
    shared out as the context without its first word has it; after none (c + 1) / (N + V + 1), V being the training
    texts' distinct tokens. A context is retained if its chances and those of the shorter context diverge: the log ratio
    summed over what follows it in training, each place left out of all counts while it is judged, is `gain` nats or
    more. A token's state is the longest retained context before it.

    All is counted over all texts, in numpy, on packed blocks of tokens: for each length blocks send their distinct
    strings to the parts of a hash range, and get the sums back. A string is asked only if its context has `least` places,
    so longer ones get rare. No table of words is held by any task.

    Defined cases: null and empty texts are one end; null ids are kept, and read as empty text when held_out isn't given;
    repeated rows count and are scored each; a long text is cut into pieces whose scores are added; no training texts
    give every token the chance 1; an empty table gives no rows; other columns are ignored. Words are told apart by
    64-bit hashes.
    """
    spark = docs.sparkSession
    held = held_out_of(id_col) if held_out is None else F.coalesce(held_out, F.lit(False))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), held.alias("held"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with settings(spark, {BATCH: "8m"}):  # rows are large: a few of them at a time are enough for a Python worker
        scored, n = _scored(base, depth, least, weight, gain, block_tokens)
    whole = scored.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _scored(base: DataFrame, depth: int, least: int, weight: float, gain: float, block_tokens: int) -> tuple[DataFrame, int]:
    """(scores of the pieces of texts, trained tokens) of texts (row, doc_id, held, text)."""
    tokens = tokenised(base, depth, block_tokens)
    size, n = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    bits = max(partitions(base.sparkSession) - 1, size // PART, 1).bit_length()

    def ask(batches):
        def rows():
            for block, totals in _rows(batches):
                *_, (at, keys, inverse, _) = block.levels(totals, least)
                given = np.bincount(inverse, weights=block.given[at], minlength=len(keys)).astype("u4")
                yield from _asks(block.block, keys, given, bits)

        yield from out_batches(rows(), _ASKED, 256)

    answers: list[DataFrame] = []
    for k in range(depth + 1):
        answers.append(_exchanged(_known(tokens, answers).mapInArrow(ask, _ASKED_SQL), f"pst-counts-{k}"))
    v = answers[0].agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]

    def diverge(batches):
        def rows():
            for block, totals in _rows(batches):
                contexts, gains, below = [], [], None
                for at, chance, context in _chances(block, totals, least, n, v, weight, 1):
                    now = np.zeros(len(block.ids)) if below is None else below.copy()
                    now[at] = chance
                    if len(context):
                        learned = block.given[at]
                        contexts.append(context)
                        ratio = np.zeros(len(at))
                        ratio[learned] = np.log(now[at][learned] / below[at][learned])
                        gains.append(ratio)
                    below = now
                if contexts:
                    keys, inverse = np.unique(np.concatenate(contexts), return_inverse=True)
                    yield from _asks(block.block, keys, _whole(np.bincount(inverse, weights=np.concatenate(gains), minlength=len(keys))), bits)

        yield from out_batches(rows(), _ASKED, 256)

    retained = _exchanged(_known(tokens, answers).mapInArrow(diverge, _ASKED_SQL), "pst-retained", gain)

    def score(batches):
        def rows():
            for block, totals in _rows(batches):
                *totals, kept = totals
                found = list(_chances(block, totals, least, n, v, weight, 0))
                keys = np.unique(np.concatenate([context for _, _, context in found]))
                base, chance = found[0][1], found[0][1].copy()
                for at, made, context in found[1:]:
                    stays = kept[np.searchsorted(keys, context)] > 0
                    chance[at[stays]] = made[stays]
                known = totals[0][block.ids] > 0
                sums = [np.add.reduceat(np.where(block.own, x, 0), block.starts) for x in (block.own.astype(np.int64), known.astype(np.int64), np.log10(base), np.log10(chance))]
                yield from ((d["row"], d["doc_id"], d["held"], int(a), int(b), float(c), float(e)) for d, a, b, c, e in zip(block.docs, *sums))

        yield from out_batches(rows(), _SCORES)

    scored = written(_known(tokens, [*answers, retained]).mapInArrow(score, _SCORES_SQL), "pst-scores")
    forget(tokens, retained, *answers)
    return scored, n
