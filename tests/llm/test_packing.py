import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from roadloom.llm import packing
from roadloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, docs, tokenizer, longest=2048):
    """Pieces give every document's ids once, and sequences without gaps; returns the share of padding."""
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(ids_of(tokenizer, t))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        if len(want[i]) == 1:
            ids, at = np.array(want[i][0], "<u4"), 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in ps) == sum(map(len, want[i]))
    used = padded = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= longest and {p.sequence_tokens for p in ps} == {at}
        used += at
        padded += at if at & (at - 1) == 0 else longest
    return 1 - used / padded


def test_whole_table(spark, sf_dir, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(QUERIES["op1_packing"](spark, sf_dir).collect(), docs, tokenizer) == 0


def test_odd_texts(docs, odd_texts, tokenizer):
    rows = packing.pack_documents(docs(odd_texts)).collect()
    assert check(rows, odd_texts, tokenizer) == 0
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}


def test_empty_table(docs):
    assert packing.pack_documents(docs([], 1)).count() == 0


def test_reruns_agree(docs, words):
    r = random.Random(1)
    d = docs([(i, " ".join(r.choices(words, k=r.randint(0, 900)))) for i in range(60)]).persist()
    assert sorted(packing.pack_documents(d, block_tokens=5000).collect()) == sorted(packing.pack_documents(d, block_tokens=5000).collect())


def test_small_blocks(docs, words, tokenizer):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 3, 40, 300, 3000])))) for i in range(50)]
    assert check(packing.pack_documents(docs(rows), block_tokens=3000).collect(), rows, tokenizer) == 0


def test_tiers_are_powers_of_two(docs):
    with pytest.raises(ValueError):
        packing.pack_documents(docs([]), tiers=(100, 2048))


def test_step_groups_weigh_alike():
    sequences = [(256, [(k, 0, 256 - k)]) for k in range(64)]
    groups = packing.step_groups(sequences, 8)
    cost = defaultdict(int)
    for (_, ps), g in zip(sequences, groups):
        cost[g] += sum(p[2] ** 2 for p in ps)
    assert max(groups.count(g) for g in set(groups)) <= 8
    assert max(cost.values()) < 1.05 * min(cost.values())


def test_encoder_is_the_tokenizer(tokenizer):
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    marks = "aB.,;:!?-'\"\u00e9\u0130\u03a3\u0301 \n\t\r\u00a0\u2028()0123456789\u4e2d\U0001f642"
    texts = ["", "...", "a., b", "İstanbul ΣΑΣ", "x" * 5000, *("".join(r.choices(marks, k=r.randint(1, 200))) for _ in range(400))]
    encode.CHUNK = 64
    for t in texts:
        assert np.frombuffer(encode.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_many_texts_are_encoded_at_once(tokenizer):
    """Lengths around the limits of a slice, texts of any script, nulls and parts that hold the mark between parts."""
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encode.CHUNK, encode.AT_ONCE, encode.LIMIT = 64, 200, 40
    r = random.Random(4)
    marks = "aB.,;:!?-'\"éİΣ́ \n\t\r  ()0123456789中\U0001f642\x01\x1c\x85"
    texts = [None, "", "\x01", "a \x01 b", *(None if r.random() < 0.05 else "".join(r.choices(marks, k=r.randint(0, 150))) for _ in range(600)), *("".join(r.choices("abAB ., ", k=r.randint(0, 150))) for _ in range(300))]
    texts += [f"x{chr(i)}. {chr(i)}, {chr(i)}X" for i in range(0x250)]
    got = list(encode.encode_many(pa.array(["away", *texts], pa.string()).slice(1)))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_special_tokens_keep_their_case(tokenizer):
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("<|ENDOFTEXT|> a", "A <|endoftext|>. B", "<|EndOfText|>, <|startoftext|>x"):
        assert np.frombuffer(encode.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_new_parts_take_one_call(words):
    """A call of the tokenizer for each text's few new parts cost more than their encoding."""
    encode, calls = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    inner = encode.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            calls.append(len(texts))
            return inner.encode_batch_fast(texts, **kw)

    encode.tokenizer = Counted()
    assert len(list(encode.encode_many(pa.array([f"{w} {w}x {i}" for i, w in enumerate(words)])))) == len(words)
    assert calls == [1]
