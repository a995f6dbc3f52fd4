"""Toxicity, importance resampling, mixing and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import importance, mixing, toxicity
from roadloom.llm.queries import QUERIES

# -- toxicity


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture
def marked(words):
    """Texts of which those with words of a small set are toxic."""
    r = random.Random(3)
    bad = words[:6]
    docs, labels = [], []
    for i in range(1000):
        toxic = i % 4 == 0
        text = r.choices(words[20:], k=r.randint(5, 60)) + (r.choices(bad, k=r.randint(2, 5)) if toxic else [])
        r.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic), "x"))
    return docs, labels


def test_toxicity_of_held_out_documents(spark, docs, marked):
    rows, labels = marked
    got = toxicity.score_documents(docs(rows), labelled(spark, labels)).collect()
    truth = {i: y for i, _, y, _ in labels}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.doc_id not in r.evidence
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_toxicity_learns_from_no_held_out_label(spark, docs, marked):
    rows, labels = marked
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, q, y, t in labels]
    a = toxicity.score_documents(docs(rows), labelled(spark, labels)).select("doc_id", "score")
    b = toxicity.score_documents(docs(rows), labelled(spark, turned)).select("doc_id", "score")
    assert sorted(a.collect()) == sorted(b.collect())


def test_toxicity_of_the_table(spark, sf_dir):
    """Over the labelled rows that are held out, of a table with enough labels to learn from."""
    sf_dir = f"{sf_dir.rpartition('/')[0]}/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in QUERIES["op8_toxicity"](spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    one, none = [r.score for r in got if labels[r.doc_id] == 1], [r.score for r in got if labels[r.doc_id] == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in one for b in none]) > 0.9
    assert np.mean([a >= 0.5 for a in one]) > 0.6 and np.mean([b >= 0.5 for b in none]) < 0.02


def test_toxicity_same_as_all_cosines(spark, docs, marked):
    """Every score from the model's terms, by cosines with all examples."""
    rows, labels = marked
    d, known = docs(rows[:400] + [(2000, rows[4][1]), (2001, rows[4][1])]), labelled(spark, labels)
    m = toxicity.fit(d, known)
    count, index = toxicity.TermCounter(m.terms), m.index
    dense = np.zeros((len(index.ids), len(m.terms)))
    for t, (a, b) in enumerate(zip(index.start[index.first[:-1]], index.start[index.first[1:]])):
        dense[index.example[a:b], t] = index.weight[a:b]
    got = toxicity.score_documents(d, known).collect()
    for r in got[::5]:
        text = dict(rows + [(2000, rows[4][1]), (2001, rows[4][1])])[r.doc_id]
        c = count(text)
        want = m.base_rate
        if c:
            t, w = toxicity.tf_idf(c, m.idf)
            cos = dense[:, t] @ w
            cos[index.texts == toxicity.text_hash(text)] = 0
            near = [i for _, i in sorted((-round(x, 12), i) for i, x in enumerate(cos) if x > 0)[: toxicity.NEIGHBOURS]]
            want = toxicity.vote(index, np.array(near, int), cos[near], m.base_rate)
        assert r.score == pytest.approx(want)
    assert len({r.score for r in got if r.doc_id in (4, 2000, 2001)}) == 1


def test_toxicity_odd_texts(spark, docs, odd_texts):
    labels = labelled(spark, [(i, 0, i % 2, "") for i in range(1, 7)] + [(None, 0, 1, ""), (4, 0, None, ""), (5, 0, 7, "")])
    got = toxicity.score_documents(docs(odd_texts), labels).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    none = toxicity.score_documents(docs(odd_texts), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_documents(docs([], 1), labels).count() == 0


def test_block_max_search_is_exact():
    r = np.random.default_rng(2)
    idf = np.ones(40)
    vectors = [toxicity.tf_idf({int(t): int(r.integers(1, 5)) for t in r.choice(40, 5, replace=False)}, idf) for _ in range(500)]
    index = toxicity.BlockMaxIndex(vectors, np.arange(500), np.zeros(500), np.ones(500), 40)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 500, 7):
        t, w = vectors[q]
        cos = dense @ dense[q]
        cos[q] = -1
        want = sorted(((-round(c, 12), i) for i, c in enumerate(cos) if c > 0))[:15]
        ids, _ = index.search(t, w, 15, q)
        assert ids.tolist() == [i for _, i in want]


def test_without_toxic(spark, docs, marked):
    rows, labels = marked
    d = docs(rows)
    stays = toxicity.without_toxic(d, labelled(spark, labels))
    rejected = {r.doc_id for r in toxicity.score_documents(d, labelled(spark, labels)).where("predicted = 1").collect()}
    assert {r.doc_id for r in stays.collect()} == {i for i, _ in rows} - rejected
    assert stays.columns == d.columns


# -- importance


def test_importance_prefers_the_target(spark, docs, words):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(words[:200] if i % 5 == 0 else words[150:], k=60))) for i in range(400)]
    labels = labelled(spark, [(i, int(i % 5 == 0), 0, "") for i in range(0, 400, 2)])
    got = importance.importance_resample(docs(rows), labels, k=80).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept) == 80 and len([i for i in kept if i % 5 == 0]) >= 76
    again = importance.importance_resample(docs(rows, 7), labels, k=80).collect()
    assert {r.doc_id for r in again if r.kept} == kept


def test_importance_same_as_by_hand(spark, docs, words):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices(words, k=30))) for i in range(60)]
    got = {r.doc_id: r for r in importance.importance_resample(docs(rows), labelled(spark, [(i, i % 2, 0, "") for i in range(20)])).collect()}
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, t in rows:
        g = importance.gram_counts(t)
        np.add.at(raw, g, 1)
        if i < 20 and i % 2:
            np.add.at(target, g, 1)
    ratio = np.log((target / target.sum()) / (raw / raw.sum()))
    for i, t in rows:
        g = importance.gram_counts(t)
        assert got[i].n_grams == len(g) == 59 and got[i].log_weight == pytest.approx(ratio[g].mean())
        assert got[i].log_ratio == pytest.approx(ratio[g].sum())
    keys = sorted((r.sample_key for r in got.values()), reverse=True)
    assert all(r.kept == (r.sample_key >= keys[29]) for r in got.values())


def test_importance_lifts_held_out_quality(spark):
    """Learned on four folds of the labels, the sample prefers good documents of the fifth."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    got = importance.importance_resample(spark.read.parquet(f"{folder}/documents.parquet"), labels.where("not out"))
    of = {r.quality: (r.n, r.kept, r.weight) for r in got.join(labels.where("out"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.percentile_approx("log_weight", 0.5).alias("weight")).collect()}
    good, poor = of[1], of[0]
    assert good[1] / good[0] > 1.2 * poor[1] / poor[0]
    assert good[2] > poor[2]


@pytest.mark.parametrize("k,want", [(0, float("inf")), (1, 99.0), (40, 60.0), (100, 0.0), (101, float("-inf"))])
def test_kth_largest(spark, k, want):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert importance.kth_largest(df, "x", k) == want


def test_importance_odd_texts(spark, docs, odd_texts):
    labels = labelled(spark, [(5, 1, 0, ""), (6, 0, 0, ""), (None, 1, 0, ""), (1, None, 0, "")])
    got = importance.importance_resample(docs(odd_texts), labels, k=2).collect()
    assert len(got) == len(odd_texts) and sum(r.kept for r in got) == 2
    assert {r.n_grams for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert importance.importance_resample(docs([], 1), labels).count() == 0
    assert importance.importance_resample(docs(odd_texts), labels.limit(0)).count() == len(odd_texts)


# -- mixing


def sizes_of(rows):
    return {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}


def test_mixing_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op9_mixing"](spark, sf_dir).collect()}
    size, source = sizes_of([(r.doc_id, r.text) for r in docs]), {r.doc_id: r.source for r in docs}
    per = Counter()
    for i, n in size.items():
        per[source[i]] += n
    target = mixing.source_targets(dict(per))
    taken, largest = Counter(), Counter()
    for i, r in got.items():
        largest[source[i]] = max(largest[source[i]], size[i])
        assert (r.size, r.source_size) == (size[i], per[source[i]]) and r.target == pytest.approx(target[source[i]])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[source[i]] += r.taken
    for s, t in target.items():
        assert t + 1 >= taken[s] >= t - largest[s]  # whole documents only
    assert sorted(got.values()) == sorted(QUERIES["op9_mixing"](spark, sf_dir).collect())


def test_targets():
    assert mixing.source_targets({"a": 100, "b": 100, "c": 100}) == {"a": 187.5, "b": 75.0, "c": 37.5}
    t = mixing.source_targets({"a": 1, "b": 100, None: 99})
    assert t["a"] == 3 and t["b"] + t[None] == pytest.approx(197) and t["b"] == pytest.approx(2 * t[None])
    assert mixing.source_targets({}) == {}
    assert sum(mixing.source_targets({"a": 5, "b": 0}).values()) == 5


def test_flow_is_cheapest():
    """Overlapping sources: the shared pattern goes where it saves repeats."""
    supply = {("a",): 10, ("a", "b"): 10, ("b",): 10}
    flow = mixing.min_cost_flow(supply, {"a": 20, "b": 10}, (0, 1, 3))
    per = defaultdict(int)
    for (p, s), n in flow.items():
        assert s in p
        per[s] += n
    assert per == {"a": 20, "b": 10}
    assert all(sum(n for (p, _), n in flow.items() if p == q) <= 10 for q in supply)


def test_mixing_of_overlapping_sources(spark, words):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 40))), r.choice([["a"], ["a", "b"], ["b"], None])) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == 300 and all(0 <= r._times <= 3 for r in plan)
    total = sum(r._size for r in plan)
    assert abs(sum(r._size * r._times for r in plan) - total) < 0.4 * total


def test_mixing_odd_texts(docs, odd_texts):
    got = mixing.mix_report(docs(odd_texts)).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix_report(docs([], 1)).count() == 0
    assert mixing.mixed_documents(docs(odd_texts)).columns == docs(odd_texts).columns


def test_mixing_of_columns_with_clashing_names(spark):
    names = ("_base", "_cuts", "_target", "_times", "_size", "_h", "_copy", "_pattern")
    rows = [(i, "a b c d"[: 1 + i % 7], f"s{i % 3}", *range(i, i + len(names))) for i in range(40)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{n} long' for n in names)}")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(rows)
    assert len(mixing.mix_report(df).collect()) == len(mixing.mix_plan(df).collect()) == 40


# -- pipeline


def test_pipeline_stages(spark, sf_dir):
    """Each stage keeps documents' columns and only drops what its operator says; the last packs the rest."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    out = {}
    for name, stage in cp.STAGES:
        at = cp.written(stage(spark, at, sf_dir), f"test-{name}")
        out[name] = at
        if name != "packing":
            assert at.columns == docs.columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    rejected = {r.doc_id for r in QUERIES["op8_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    assert ids(out["toxicity"]) == ids(docs) - rejected
    assert ids(out["line_dedup"]) == ids(out["toxicity"])
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"].collect() if r.text is not None)
    assert ids(out["jaccard_join"]) <= ids(out["line_dedup"])
    n = sum(r.length for r in out["packing"].collect())
    assert n == sum(r.doc_tokens for r in out["packing"].collect() if r.start == 0)
    assert len(out["packing"].where("start = 0").collect()) == out["mixing"].count()


def test_pipeline_of_odd_documents(spark, sf_dir, odd_texts):
    """Null ids and texts, empty and long texts, repeated rows and columns whose names the stages use."""
    import corpus_pipeline as cp

    rows = [(i, t, None, None if i == 1 else "s", len(t or ""), i, i) for i, t in odd_texts]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _times long, doc long")
    columns = at.columns
    for name, stage in cp.STAGES:
        at = cp.written(stage(spark, at, sf_dir), f"odd-{name}")
        assert name == "packing" or at.columns == columns
        if name == "jaccard_join":
            assert sorted(r.doc_id for r in at.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6]
    assert {r.doc_id for r in at.collect()} == {None, 4, 5, 6}


def test_pipeline_of_no_documents(spark, sf_dir):
    import corpus_pipeline as cp

    at = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        at = stage(spark, at, sf_dir)
    assert at.count() == 0


def test_flow_of_many_patterns_ends_soon():
    """5,000 patterns over 40 sources; as much is carried as fits, and no word is carried beyond its readings."""
    import time

    r = random.Random(1)
    sources = [f"s{i}" for i in range(40)]
    supply = {}
    while len(supply) < 5000:
        supply[tuple(sorted(r.sample(sources, r.randint(1, 4))))] = r.randint(1, 10**6)
    quota = {s: r.randint(1, sum(supply.values()) // 15) for s in sources}
    began = time.perf_counter()
    flow = mixing.min_cost_flow(supply, quota, (0, 1, 3))
    assert time.perf_counter() - began < 30
    by_pattern, by_source = {}, {}
    for (p, s), words in flow.items():
        by_pattern[p], by_source[s] = by_pattern.get(p, 0) + words, by_source.get(s, 0) + words
        assert s in p and words > 0
    assert all(words <= 3 * supply[p] for p, words in by_pattern.items())
    assert by_source == quota  # these quotas all fit
