"""The suffix tree's scores against dictionaries, and on texts that it hasn't seen."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.llm import suffix_tree
from roadloom.llm.queries import QUERIES


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


class Plain:
    """The same tree in dictionaries: counts of all strings, chances by recursion."""

    def __init__(self, rows, depth, least, weight, gain):
        self.depth, self.least, self.weight = depth, least, weight
        self.n = Counter()
        train = [words_of(t) for i, t in rows if not held(i)]
        for w in train:
            for at in range(len(w)):
                for k in range(min(at, depth) + 1):
                    self.n[tuple(w[at - k : at + 1])] += 1
        self.total = sum(len(w) for w in train)
        self.kinds = sum(len(g) == 1 for g in self.n)
        gains = defaultdict(float)
        for w in train:
            for at in range(len(w)):
                chances = self.chances(w, at, 1)
                for k in range(1, len(chances)):
                    gains[tuple(w[at - k : at])] += math.log(chances[k] / chances[k - 1])
        self.kept = {s for s, g in gains.items() if g >= gain}

    def chances(self, w, at, without=0):
        out = [(self.n[w[at],] + 1 - without) / max(1, self.total - without + self.kinds + 1)]
        for k in range(1, min(at, self.depth) + 1):
            times = self.n[tuple(w[at - k : at])]
            if times < self.least:
                break
            out.append((self.n[tuple(w[at - k : at + 1])] - without + self.weight * out[-1]) / (times - without + self.weight))
        return out

    def score(self, text):
        w = words_of(text)
        base = score = 0.0
        for at in range(len(w)):
            c = self.chances(w, at)
            state = max([0, *(k for k in range(1, len(c)) if tuple(w[at - k : at]) in self.kept)])
            base, score = base + math.log10(c[0]), score + math.log10(c[state])
        return len(w), sum(self.n[x,] > 0 for x in w), base, score


def check(df, rows, **params):
    model = Plain(rows, params.get("depth", 2), params.get("least", 4), params.get("weight", 300.0), params.get("gain", 10.0))
    want = sorted(((i, held(i), *model.score(t)) for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in df.collect()), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(sorted(got, key=lambda x: (str(x[0]), x[4], x[5])), sorted(want, key=lambda x: (str(x[0]), x[4], x[5]))):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)
    return model


def corpus(n=120, seed=3):
    """Texts of a chain of second order over few words, so that two words tell more than one."""
    r = random.Random(seed)
    names = [f"w{i}" for i in range(12)] + ["Über", "THE", "the"]
    follow = {}
    rows = []
    for i in range(n):
        a, b, out = "w0", "w1", []
        for _ in range(r.randint(1, 150)):
            c = r.choice(follow.setdefault((a, b), r.sample(names, 2))) if r.random() < 0.8 else r.choice(names)
            out.append(c)
            a, b = b, c
        rows.append((i, r.choice([" ", "\n", "\t ", "\x0b"]).join(out)))
    return rows


def test_words_of_slices():
    texts = pa.array([t for _, t in corpus()] + [None, "", " a  b "])
    want = [len(words_of(t)) for t in texts.to_pylist()]
    for at in (0, 1, 50, len(texts) - 2, len(texts)):
        assert [len(w) for w in suffix_tree.word_arrays(texts.slice(at))] == want[at:]


@pytest.mark.parametrize("params", [{}, {"depth": 3, "least": 2, "weight": 1.5, "gain": 0.5}, {"depth": 1, "gain": 0.0}, {"block_tokens": 64, "depth": 3, "least": 3, "weight": 8.0, "gain": 4.0}])
def test_same_as_dictionaries(spark, docs, params):
    rows = corpus()
    model = check(suffix_tree.score_texts(docs(rows), **params), rows, **params)
    assert model.kept


def test_chances_of_all_tokens_add_to_one():
    rows = corpus()
    model = Plain(rows, 2, 4, 8.0, 4.0)
    known = [g[0] for g in model.n if len(g) == 1]
    for s in list(model.kept)[:10]:
        assert sum(model.chances([*s, x], len(s))[-1] for x in known) + model.chances([*s, "unknown word"], len(s))[-1] == pytest.approx(1)


def test_odd_texts(spark, docs, odd_texts):
    rows = corpus(40) + [(i if i is None else i + 500, t) for i, t in odd_texts] + [(600, "A b\x1dc\xa0d"), (601, "\x00 x")]
    check(suffix_tree.score_texts(docs(rows)), rows)
    assert suffix_tree.score_texts(docs([])).collect() == []
    r = suffix_tree.score_texts(docs([(9, "a b")]), held_out=F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_longer_contexts_help_on_texts_not_learned_from(spark, docs):
    rows = corpus(400)
    out = [r for r in suffix_tree.score_texts(docs(rows), weight=8.0).collect() if r.held_out]
    one = {r.doc_id: r.score for r in suffix_tree.score_texts(docs(rows), depth=1, weight=8.0).collect()}
    assert len(out) > 30 and sum(r.score for r in out) > sum(one[r.doc_id] for r in out) > sum(r.base_score for r in out)


def test_many_texts_lose_no_word(spark, words):
    """More text than one slice of a batch, in many blocks."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 400)))) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.n_tokens for x in suffix_tree.score_texts(df, depth=1, block_tokens=1 << 17).collect()}
    assert got == {i: len(t.split()) + 1 for i, t in rows}


def test_op11_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = QUERIES["op11_suffix_tree"](spark, sf_dir)
    check(df, rows)
    out = [r for r in df.collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
