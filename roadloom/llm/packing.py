"""Hierarchical multi-length packing of tokenised documents into fixed context sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens long, step_group long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("sequence_tokens", pa.int64()), ("step_group", pa.int64())])
Piece = tuple[int, int, int]  # item, first token in it, tokens


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, drops white space and never merges across it, nor from letters and digits to marks,
    so the ids of a text are those of its parts, one after the other. Arrow splits many texts at once and numbers
    their distinct parts; parts met before are looked up, new ones are encoded as one text, with a mark between them.
    Lower case and full stops and commas apart make fewer parts. The table is bounded.
    """

    LIMIT = 900_000
    CHUNK = 1 << 20
    #: Bytes of text that are split at once.
    AT_ONCE = 1 << 22
    #: Characters up to U+024F have a lower case that doesn't depend on their place and join no mark; U+0130 apart. Special
    #: tokens are told from other marks by their case.
    SPECIAL = r"[^\x{00}-\x{24F}]|\x{130}|<\|"
    #: A full stop or comma behind another mark is one part with it.
    JOINED = r"[^\p{L}\p{N} ][.,]"
    #: Stands between new parts; has one id of its own.
    BETWEEN = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.between = self._ids([self.BETWEEN])[0]

    def _chunks(self, text: str) -> Iterator[str]:
        """The text in pieces that end before white space."""
        at = 0
        while len(text) - at > self.CHUNK:
            cut = max(text.rfind(" ", at + 1, at + self.CHUNK), text.rfind("\n", at + 1, at + self.CHUNK))
            cut = cut if cut > at else min(x for x in (text.find(" ", at + 1), text.find("\n", at + 1), len(text)) if x > 0)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _parts(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring(texts, "\n", " ")
        plain = pc.invert(pc.match_substring_regex(texts, self.SPECIAL))
        texts = pc.if_else(plain, pc.utf8_lower(texts), texts)
        apart = pc.and_(plain, pc.invert(pc.match_substring_regex(texts, self.JOINED)))
        stops = pc.binary_join_element_wise(texts, *[pa.scalar(x, texts.type) for x in ("", " ")])
        for x in ".,":
            stops = pc.replace_substring(stops, f"{x} ", f" {x} ")
        return pc.split_pattern(pc.if_else(apart, stops, texts), " ")

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_new(self, parts: list[str]) -> list[bytes]:
        text = f" {self.BETWEEN} ".join(parts)
        if len(self.between) != 4 or text.count(self.BETWEEN) >= len(parts):
            return self._ids(parts)
        ids = np.frombuffer(self._ids([text])[0], "<u4")
        ends = [*np.flatnonzero(ids == np.frombuffer(self.between, "<u4")[0]).tolist(), len(ids)]
        held, at, out = ids.tobytes(), 0, []
        for end in ends:
            out.append(held[4 * at : 4 * end])
            at = end + 1
        return out

    def _lookup(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts."""
        got = list(map(self.known.get, parts))
        new = [k for k, x in enumerate(got) if x is None]
        if new:
            for k, ids in zip(new, self._encode_new([parts[k] for k in new]), strict=True):
                got[k] = ids
                if len(self.known) < self.LIMIT and len(parts[k]) <= 64:
                    self.known[parts[k]] = ids
        return got

    def _encode_at_once(self, texts: pa.Array) -> list[bytes]:
        lists = self._parts(texts)
        bounds = lists.offsets.to_numpy()
        parts = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        got = self._lookup(parts.dictionary.to_pylist())
        ids, sizes = np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) >> 2
        which = parts.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[bounds - bounds[0]]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, before + self.AT_ONCE, "right")))
            if ends[at] - before > self.CHUNK:
                yield b"".join(self._encode_at_once(pa.array([x], pa.large_string()))[0] for x in self._chunks(texts[at].as_py()))
                end = at + 1
            else:
                # a longer text is taken on its own
                longer = np.flatnonzero(np.diff(ends[at:end]) > self.CHUNK)
                end = at + 1 + int(longer[0]) if len(longer) else end
                yield from self._encode_at_once(texts.slice(at, end - at))
            at, before = end, int(ends[end - 1])

    def encode(self, text: str) -> bytes:
        return next(self.encode_many(pa.array([text], pa.string())))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One loaded tokenizer a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Pool:
    """Items of short tiers, taken longest-that-fits first."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []  # tokens, item, start

    def __len__(self) -> int:
        return len(self.items)

    def add(self, item: int, start: int, tokens: int) -> None:
        insort(self.items, (tokens, item, start))

    def take(self, room: int) -> Piece:
        """The longest item that fits; else the head of the shortest one, cut to fit."""
        k = bisect_right(self.items, (room + 1,)) - 1
        tokens, item, start = self.items.pop(max(k, 0))
        if tokens > room:
            self.add(item, start + room, tokens - room)
        return item, start, min(tokens, room)


def pack_block(items: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Pack (item, first token, tokens) into full sequences. Returns (tier, pieces) and the pieces left over, under one window.

    Items beyond the longest tier give whole windows and a rest. Each rest goes to the shortest tier that
    holds it. From the longest tier down, every item opens a window whose gap is filled from shorter tiers,
    longest that fits first; the last filler is cut to fit.
    """
    full: list[tuple[int, list[Piece]]] = []
    longest = tiers[-1]
    routed: dict[int, list[Piece]] = {t: [] for t in tiers}
    for item, start, tokens in items:
        while tokens >= longest:
            full.append((longest, [(item, start, longest)]))
            start, tokens = start + longest, tokens - longest
        if tokens:
            routed[next(t for t in tiers if tokens <= t)].append((item, start, tokens))
    pool = Pool()
    for t in tiers[:-1]:
        for piece in routed[t]:
            pool.add(*piece)
    own = sorted(routed[longest], key=lambda p: (p[2], -p[0]))
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        if k < len(tiers) - 1:
            # what is left in the pool and belongs to this tier
            below = tiers[k - 1] if k else 0
            at = bisect_right(pool.items, (below + 1,))
            own = own + [(i, s, n) for n, i, s in pool.items[at:]]
            own.sort(key=lambda p: (p[2], -p[0]))
            del pool.items[at:]
        while own:
            item, start, tokens = own.pop()
            if tokens > tier:
                own.append((item, start + tier, tokens - tier))
                tokens = tier
            pieces, room = [(item, start, tokens)], tier - tokens
            while room and (len(pool) or own):
                if len(pool):
                    piece = pool.take(room)
                else:  # no shorter items: go on with the shortest of this tier
                    item, start, tokens = own.pop(0)
                    piece = (item, start, min(tokens, room))
                    if tokens > room:
                        own.insert(0, (item, start + room, tokens - room))
                pieces.append(piece)
                room -= piece[2]
            if room:
                return full, pieces
            full.append((tier, pieces))
    return full, []


def powers(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The last pieces of a task as sequences whose lengths are powers of two, which need no padding."""
    total, out = sum(p[2] for p in pieces), []
    rest = list(pieces)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, held = 1 << bit, []
            while room:
                item, start, tokens = rest.pop(0)
                if tokens > room:
                    rest.insert(0, (item, start + room, tokens - room))
                    tokens = room
                held.append((item, start, tokens))
                room -= tokens
            out.append((1 << bit, held))
    return out


def step_groups(sequences: list[tuple[int, list[Piece]]], size: int) -> list[int]:
    """A step for each sequence: sequences of one tier, dealt back and forth by attention cost so that steps weigh alike."""
    steps, first = [0] * len(sequences), 0
    by_tier: dict[int, list[int]] = {}
    for i, (tier, _) in enumerate(sequences):
        by_tier.setdefault(tier, []).append(i)
    for tier in sorted(by_tier):
        own = sorted(by_tier[tier], key=lambda i: (-sum(p[2] ** 2 for p in sequences[i][1]), i))
        n = -(-len(own) // size)
        for rank, i in enumerate(own):
            lap, at = divmod(rank, n)
            steps[i] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return steps


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_size: int = 8, block_tokens: int = 1 << 21) -> DataFrame:
    """Pack all documents into sequences; one row for each piece of a document.

    Each document is its tokenizer ids and then end_id; every id lies in exactly one piece. Pieces of a
    sequence lie one after the other from offset 0. Sequences are full at one of the tiers (powers of two);
    what is left at the end of a task, less than one window of the longest tier and the rest of a block,
    becomes sequences of smaller powers of two, so nothing is padded. `tier` is a sequence's padded length.
    `step_group` joins up to step_size sequences of a tier that make one training step.

    Nothing is shuffled: a task packs the documents it reads, in blocks of at most block_tokens and one
    document, and gives the same pieces when it is run again.

    Defined cases: null and empty texts are documents of the one id end_id; null ids stay null; rows that
    repeat are packed each on its own; ties go by the order of reading; an empty table gives no rows; other
    columns are ignored.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encode, base = encoder(path).encode_many, TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, bytes]] = []
        left: list[Piece] = []
        tokens = sequence = step = 0

        def flush(last: bool):
            nonlocal held, left, tokens, sequence, step
            items = left + [(i, 0, len(ids) // 4) for i, (_, ids) in enumerate(held) if i not in carried]
            full, rest = pack_block(items, tiers)
            if last:
                full += powers(rest)
                rest = []
            steps = step_groups(full, step_size)
            rows = []
            for (tier, pieces), group in zip(full, steps):
                at = 0
                length = sum(p[2] for p in pieces)
                for item, start, n in pieces:
                    doc_id, ids = held[item]
                    rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, base + sequence, at, tier, length, base + step + group))
                    at += n
                sequence += 1
            step += max(steps, default=-1) + 1
            keep = {item: k for k, item in enumerate(dict.fromkeys(p[0] for p in rest))}
            held = [held[item] for item in keep]
            left = [(keep[item], start, n) for item, start, n in rest]
            carried.clear()
            carried.update(range(len(held)))
            tokens = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        carried: set[int] = set()
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                held.append((doc_id, ids + end))
                tokens += len(ids) // 4 + 1
                if tokens >= block_tokens:
                    yield from flush(False)
        yield from flush(True)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
