"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import xxhash

from roadloom.llm.common import id_crc32

#: Documented bound of the classifier's sample: labelled rows used of each label.
EXAMPLES = 10_000
#: A term counts if its texts differ from the others in labels by more than chance (G-squared of one degree of freedom).
LEAST_G = 18.0
#: and lean to toxic by this part of the rate that remains: frequent words of clean texts would make every text meet all examples.
LEAN = 0.25
NEIGHBOURS, BLOCK = 15, 64
#: A document whose neighbours' weights add up to this counts half its neighbours and half the base rate.
PRIOR = 0.35
_WORD = re.compile(r"\w+")


def word_terms(word: str) -> tuple[str, ...]:
    """The word and its starts of 4 and 5 letters, so that endings don't hide a stem."""
    return (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k))


class TermCounter:
    """Counts of known terms in a text. Words that hold no known term are remembered, up to a bound."""

    LIMIT = 400_000

    def __init__(self, terms: dict[str, int]):
        self.terms, self.none = terms, set()

    def __call__(self, text: str) -> dict[int, int]:
        words = _WORD.findall(text.lower())
        out: dict[int, int] = {}
        hits = []
        for w in set(words).difference(self.none):
            own = [self.terms[t] for t in word_terms(w) if t in self.terms]
            if own:
                hits.append((w, own))
            elif len(self.none) < self.LIMIT and len(w) < 64:
                self.none.add(w)
        for w, own in hits:
            n = words.count(w)
            for t in own:
                out[t] = out.get(t, 0) + n
        return out


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    base_rate: float  # of examples that hold no known term
    index: "BlockMaxIndex | None"


def tf_idf(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of length 1: (1 + ln tf) * idf."""
    t = np.fromiter(sorted(counts), np.int64, len(counts))
    w = (1 + np.log(np.array([counts[i] for i in t.tolist()], float))) * idf[t]
    n = np.sqrt((w * w).sum())
    return t, w / n if n else w


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each span, one span after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


class BlockMaxIndex:
    """Postings of examples by term and block of examples, with the largest weight of each such cell."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_terms: int, texts: np.ndarray | None = None):
        self.ids, self.labels, self.weights = ids, labels, weights
        self.texts = ids if texts is None else texts  # what tells an example's text from another one
        self.blocks = -(-len(vectors) // BLOCK)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors])
        weight = np.concatenate([w for _, w in vectors])
        by = np.lexsort((example, term))
        self.example, self.weight = example[by], weight[by]
        cell = term[by] * self.blocks + self.example // BLOCK
        cells, self.start = np.unique(cell, return_index=True)
        self.start = np.append(self.start, len(cell))
        self.top = np.maximum.reduceat(self.weight, self.start[:-1])
        self.block = cells % self.blocks
        self.first = np.searchsorted(cells, np.arange(n_terms + 1) * self.blocks)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, leave_out: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, ties to the earlier example: blocks in the order of their bounds until a bound falls below the k-th cosine.

        Only the postings of a block's own cells are read. Examples whose text is leave_out don't count.
        """
        n = self.first[terms + 1] - self.first[terms]
        cells, w = spans(self.first[terms], n), np.repeat(weights, n)
        block = self.block[cells]
        bound = np.bincount(block, w * self.top[cells], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        cos, ids, kth = np.empty(0), np.empty(0, np.int64), -1.0
        at, step = 0, max(1, 2 * k // BLOCK + 1)
        while at < len(order):
            some = order[at : at + step]
            some = some[bound[some] >= kth - 1e-12]
            if not len(some):
                break
            at, step = at + step, step * 2
            wanted = np.zeros(self.blocks, bool)
            wanted[some] = True
            own = wanted[block]
            size = self.start[cells[own] + 1] - self.start[cells[own]]
            posts = spans(self.start[cells[own]], size)
            # places of the examples of these blocks alone
            place = np.cumsum(wanted) - 1
            e = self.example[posts]
            score = np.bincount(place[e // BLOCK] * BLOCK + e % BLOCK, np.repeat(w[own], size) * self.weight[posts], minlength=len(some) * BLOCK)
            hit = np.nonzero(score)[0]
            score, hit = score[hit], np.nonzero(wanted)[0][hit // BLOCK] * BLOCK + hit % BLOCK
            if leave_out is not None:
                other = self.texts[hit] != leave_out
                score, hit = score[other], hit[other]
            cos, ids = np.concatenate([cos, score]), np.concatenate([ids, hit])
            keep = np.lexsort((ids, -np.round(cos, 12)))[:k]
            cos, ids = cos[keep], ids[keep]
            kth = cos[-1] if len(cos) == k else -1.0
        return ids, cos


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def vote(index: BlockMaxIndex, near: np.ndarray, cos: np.ndarray, base_rate: float) -> float:
    """Neighbours weigh by the square of their cosine and by how many labelled rows they stand for."""
    w = cos**2 * index.weights[near]
    prior = PRIOR * float(np.mean(index.weights))
    return float((w @ index.labels[near] + prior * base_rate) / (w.sum() + prior))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, least_g: float = LEAST_G, folds: int = 5) -> Model:
    """Learn terms and examples from labelled rows whose crc32(id) mod folds isn't 0.

    At most `examples` rows of each label, by the order of a hash, are used (the documented bound of the
    classifier's sample). Terms are all words and starts of words that stand in three or more of these texts and whose
    texts are toxic more often than others by more than chance (G-squared >= least_g, LEAN); equal texts count once there. Their number is bounded by the sample. Document frequencies for IDF cover all of docs.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (id_crc32(id_col) % folds != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not totals:
        return Model({}, np.empty(0), 0.0, None)
    picked = known.where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(examples).union(known.where("_y = 0").orderBy(F.xxhash64("_id"), "_id").limit(examples))
    spark = docs.sparkSession
    picked = spark.createDataFrame(picked.collect(), "_id long, _y int")  # 2 * examples rows at most
    sample = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")

    def bag(batches):
        for b in batches:
            y, h, t = [], [], []
            for label, text in zip(b.column("_y").to_pylist(), b.column("_text").to_pylist()):
                own = {x for w in set(_WORD.findall(text.lower())) for x in word_terms(w)}
                y += [label] * len(own)
                t += own
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(t, pa.string())], names=["y", "term"])

    once = sample.groupBy(F.xxhash64("_text")).agg(F.max("_y").alias("_y"), F.first("_text").alias("_text")).select("_y", "_text")
    n1, n0 = once.agg(F.sum("_y"), F.sum(1 - F.col("_y"))).first()
    n1, n0 = n1 or 0, n0 or 0
    rate = n1 / max(1, n1 + n0)
    counts = once.mapInArrow(bag, "y int, term string").groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where("n >= 3")
    flat = lambda x, p: x * F.log(F.greatest(x, F.lit(0.5)) / p)
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    g = 2 * (flat(a, n * max(rate, 1e-9)) + flat(n - a, n * max(1 - rate, 1e-9)))
    chosen = counts.where((g >= least_g) & (a / n > rate + (1 - rate) * LEAN)).collect()  # of the bounded sample
    vocabulary = {t: i for i, t in enumerate(sorted(r.term for r in chosen))}

    def frequencies(batches):
        count, seen, rows = TermCounter(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for at in range(0, b.num_rows, 256):
                for text in b.column(0).slice(at, 256).to_pylist():
                    for t in count(text or ""):
                        seen[t] += 1
        hit = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *hit], pa.int32()), pa.array([rows, *seen[hit]], pa.int64())], names=["term", "n"])

    df = {r.term: r.n for r in docs.select(text_col).mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(len(vocabulary))], float))) + 1

    def vectors(batches):
        count = TermCounter(vocabulary)
        for b in batches:
            own = [count(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array([text_hash(t) for t in b.column("_text").to_pylist()], pa.int64()), pa.array([list(c) for c in own], pa.list_(pa.int32())), pa.array([list(c.values()) for c in own], pa.list_(pa.int32()))], names=["id", "y", "text", "terms", "tf"])

    got = sorted(sample.mapInArrow(vectors, "id long, y int, text long, terms array<int>, tf array<int>").collect(), key=lambda r: (r.id, r.text))
    stand = {y: totals.get(y, 0) / max(1, min(examples, totals.get(y, 0))) for y in (0, 1)}
    silent = {y: sum(stand[y] for r in got if r.y == y and not r.terms) for y in (0, 1)}
    base = silent[1] / max(1e-9, silent[0] + silent[1])
    said = [r for r in got if r.terms]
    if not said:
        return Model(vocabulary, idf, base, None)
    # near examples lie side by side, so that block maxima are tight
    made = sorted(((tf_idf(dict(zip(r.terms, r.tf)), idf), r) for r in said), key=lambda x: (int(x[0][0][np.argmax(x[0][1])]), x[1].text, x[1].id))
    index = BlockMaxIndex([v for v, _ in made], np.array([r.id for _, r in made]), np.array([r.y for _, r in made], float), np.array([stand[r.y] for _, r in made]), len(vocabulary), np.array([r.text for _, r in made]))
    return Model(vocabulary, idf, base, index)


class Scorer:
    """Scores texts against a model; equal term counts are looked up."""

    def __init__(self, model: Model):
        self.model, self.count, self.known = model, TermCounter(model.terms), {}
        self.own = set(model.index.texts.tolist()) if model.index else set()

    def __call__(self, text: str | None) -> tuple[float, list[int]]:
        m, counts = self.model, self.count(text or "")
        if not counts or m.index is None:
            return m.base_rate, []
        own = text_hash(text)
        key = (tuple(sorted(counts.items())), own if own in self.own else None)
        if key not in self.known:
            near, cos = m.index.search(*tf_idf(counts, m.idf), NEIGHBOURS, key[1])
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = vote(m.index, near, cos, m.base_rate), m.index.ids[near[:3]].tolist()
        return self.known[key]


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, folds: int = 5, **options) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, evidence (ids of the nearest examples).

    The score is a distance-weighted vote of the nearest labelled examples by exact TF-IDF cosine, pulled
    towards the base rate where neighbours are far. Only texts make scores: a text never meets examples of its own
    text, whatever their ids, so equal texts score alike.

    Defined cases: null and empty texts, and texts without a known term, get the base rate of such examples;
    null ids count as held out (no crc32); repeated rows get a row each; labels other than 0 and 1 are
    ignored, a document labelled twice takes the larger; no labels: score 0; an empty table gives no rows;
    other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, folds=folds, **options))

    def run(batches):
        score = Scorer(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", F.coalesce(id_crc32("doc_id") % folds == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """docs without the documents that score_documents() would reject; decided in the pass that reads them.

    Defined cases: as there; null ids, repeated rows and columns of any name stay as they are unless their text is
    rejected; null and empty texts stay, unless most labelled texts without a known term are toxic.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **options))
    where = docs.columns.index(text_col)

    def run(batches):
        score = Scorer(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                keep = [score(t)[0] < threshold for t in part.column(where).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
