"""Line dedup, Jaccard join, repeated passages and URL filter against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from roadloom.llm import jaccard_join, line_dedup, suffix_dedup, url_filter
from roadloom.llm.queries import ORACLE, QUERIES

# -- lines


def line_set(line):
    return frozenset(w for w in re.split(r"[^\w]|_", line.lower()) if w)


def brute_lines(rows, threshold=0.8):
    """(id, text) -> numbers of the lines that go, for distinct rows."""
    lines = [(i, n, line_set(x), t) for i, t in sorted(set(rows), key=lambda r: r[0]) if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = defaultdict(list)
    for k, (i, n, s, _) in enumerate(lines):
        if any(len(s & o) * 5 >= len(s | o) * 4 for _, _, o, _ in lines[:k]):
            gone[i].append(n)
    return {i: gone[i] for i, _ in rows}


def some_lines(words, seed=1, n=40):
    r = random.Random(seed)
    pool = [r.sample(words, r.randint(1, 14)) for _ in range(25)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(pool))
            if r.random() < 0.6 and len(line) > 2:
                line[r.randrange(len(line))] = r.choice(words)
            own.append(" ".join(line))
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize("hub_tokens", [5, 2])
def test_lines_same_as_all_pairs(spark, docs, words, monkeypatch, hub_tokens):
    monkeypatch.setattr(line_dedup, "HUB_TOKENS", hub_tokens)
    rows = some_lines(words, hub_tokens)
    got = line_dedup.line_dedup(docs(rows)).collect()
    want = brute_lines(rows)
    assert {r.doc_id: r.removed_lines for r in got} == want
    texts = dict(rows)
    for r in got:
        assert r.text == "\n".join(x for n, x in enumerate(texts[r.doc_id].split("\n")) if n not in want[r.doc_id])
        assert r.n_lines == len(texts[r.doc_id].split("\n"))


def test_lines_odd_texts(docs, odd_texts):
    rows = line_dedup.line_dedup(docs(odd_texts)).collect()
    assert len(rows) == len(odd_texts)
    got = {r.doc_id: r for r in rows}
    assert got[1].text is None and got[1].n_lines == 0 and got[2].text == "" and got[3].text == " \n\t " and got[3].n_lines == 2
    assert got[6].removed_lines == [3] and got[6].text == "Ümläut ИМЯ 漢字 ½ 🙂\nline\n"
    assert "kept" in rows[0].asDict() and got[None].text == "no id here"


def test_lines_empty_table(docs):
    assert line_dedup.line_dedup(docs([], 1)).count() == 0


def test_lines_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op5_line_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: r.removed_lines for r in got} == brute_lines(rows)
    assert all(r.n_removed == len(r.removed_lines) for r in got)


@pytest.mark.parametrize("names", [("doc", "text_hash", "_removed"), ("_doc", "_hash", "_lines"), ("__doc", "at", "n_lines"), ("class", "h", "removed_lines")])
def test_lines_of_columns_with_clashing_names(spark, names):
    rows = [(i, "one two three\nfour five" if i % 2 else f"line {i}\none two three", i, i + 1, i + 2) for i in range(12)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} long' for n in names)}")
    got = line_dedup.line_dedup(df).collect()
    want = brute_lines([(r[0], r[1]) for r in rows])
    assert {r.doc_id: r.removed_lines for r in got} == want
    for r in got:
        for k, n in enumerate(names):
            assert n in ("n_lines", "removed_lines") or r[n] == r.doc_id + k


# -- documents


def grams(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_join(rows, threshold=0.8):
    ids, sets = [i for i, _ in rows], [grams(t) for _, t in rows]
    near = [[b for b in range(len(ids)) if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])] for a in range(len(ids))]
    comp = list(ids)
    for _ in ids:
        new = [min([comp[a], *(comp[b] for b in near[a])]) for a in range(len(ids))]
        if new == comp:
            break
        comp = new
    return {i: (len(near[a]), comp[a]) for a, i in enumerate(ids)}


def near_copies(words, seed=5, groups=12):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = r.choices(words, k=r.randint(30, 200))
        for _ in range(1 + g % 5):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, rows[2][1]) for k in range(6)]
    return rows


def test_join_same_as_all_pairs(docs, words):
    rows = near_copies(words) + [(800, "two words"), (801, "Two, words!"), (802, None), (803, ""), (804, "... ---")]
    got = jaccard_join.jaccard_join(docs(rows)).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == brute_join(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_join_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_links, r.component_id) for r in QUERIES["op10_jaccard_join"](spark, sf_dir).collect()}
    assert got == brute_join(rows)


def test_join_of_small_blocks(docs, words):
    rows = near_copies(words, 6, 3) + [(500 + k, " ".join(["same"] * 3 + words[:60] + [str(k)])) for k in range(30)]
    got = jaccard_join.jaccard_join(docs(rows), block=8).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == brute_join(rows)


def test_join_odd_texts_and_empty(docs, odd_texts):
    got = [(r.doc_id, r.n_links, r.component_id) for r in jaccard_join.jaccard_join(docs(odd_texts)).collect()]
    assert sorted(got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 0, 5), (6, 0, 6)]
    assert jaccard_join.jaccard_join(docs([], 1)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        jaccard_join.choose_bands(0.01, 0.9999, 8)


# -- passages


def brute_words(rows, least=50):
    """id -> places of words in windows of `least` words that stand elsewhere too."""
    seen = defaultdict(list)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].append((i, k))
    out = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                out[i].update(range(k, k + least))
    return dict(out)


def covered(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    return dict(out)


def test_passages_same_as_all_windows(docs, words):
    r = random.Random(8)
    text = lambda n: r.choices(words, k=n)
    shared = [text(n) for n in (49, 50, 51, 90, 400)]
    rows = [(i, " ".join(text(r.randint(0, 120)) + shared[i % 5] + text(r.randint(0, 120)))) for i in range(30)]
    rows += [(90, " ".join(shared[3] + text(7) + shared[3])), (91, rows[7][1]), (92, "short"), (93, None)]
    got = suffix_dedup.repeated_passages(docs(rows))
    assert covered(got) == brute_words(rows)


def test_passages_under_one_word_order(docs, words):
    """Hundreds of holders of one passage, over many tasks."""
    r = random.Random(9)
    passage = r.choices(words, k=70)
    rows = [(i, " ".join(r.choices(words, k=20) + passage + r.choices(words, k=20))) for i in range(200)]
    assert covered(suffix_dedup.repeated_passages(docs(rows, 8))) == brute_words(rows)


@pytest.mark.parametrize("n", [45, 49, 52])
def test_passages_that_many_hold_and_few_go_on(docs, words, n):
    """Many holders of nearly a passage; some agree on a few more words to the left, the right or both."""
    r = random.Random(n)
    core = r.choices(words, k=n)
    rows = [(i, " ".join(r.choices(words, k=9) + r.choices(words[:4], k=3) + core + r.choices(words[:4], k=3) + r.choices(words, k=9))) for i in range(150)]
    assert covered(suffix_dedup.repeated_passages(docs(rows, 5))) == brute_words(rows)


@pytest.mark.parametrize("space", ["\u3000", "\u00a0", "\u0085"])
def test_passages_of_copies_parted_by_other_spaces(docs, words, space):
    """Whole copies count words as passages do, whatever white space parts them."""
    rows = [(i, space.join(words[:60])) for i in (1, 2, 3)] + [(4, space.join(words[100:149])), (5, space.join(words[100:149]))]
    got = suffix_dedup.repeated_passages(docs(rows)).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words, r.other_doc_id) for r in got) == [(1, 0, 60, 3), (2, 0, 60, 1), (3, 0, 60, 1)]


def test_passages_odd_texts_and_empty(docs, odd_texts):
    got = suffix_dedup.repeated_passages(docs(odd_texts))
    assert set(covered(got)) == {5}
    assert suffix_dedup.repeated_passages(docs([], 1)).count() == 0


def test_passage_window_must_fit(docs):
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(docs([]), least_words=20)


# -- URLs

URLS = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://a.com/en/x?y#z", "http://Example.COM/en/7?q", "http://sub.example.com/en/7x", "http://notexample.com/en/7", "http://x.net/de/", "http://example.net/de/8", "http://b.example.net/de/81#f", "http://o.org/es/", "http://o.org/es", "http://com/en/", "x://a.com?/en/", "ü://É.com/en/", "http://user@a.com:80/en/", "http://a.com/en/7://b.org/es/"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    hits = [(len(h + p), len(h), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(hits)[2], max(hits)[3]) if hits else (host, path, None, "allow")


def test_urls_same_as_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    got = url_filter.filter_urls(pages, url_filter.rules_table(spark)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute_url(u) for i, u in enumerate(URLS * 2)}
    assert len(got) == 2 * len(URLS)


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    none = spark.createDataFrame([], "action string, rule_host string, rule_path string")
    assert url_filter.filter_urls(pages, none).first().verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_filter_grows_with_the_rules(spark):
    """Thousands of rules: verdicts as by hand, and the filter still stops most keys that no rule has."""
    rules = [("block", f"H{i}.Example", f"/p{i % 7}/") for i in range(20_000)]
    table = url_filter.rules_table(spark, rules)
    urls = [f"http://www.h{i}.example/p{i % 5}/x" for i in range(0, 40_000, 13)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for blocks in (None, 16):  # a filter that is far too small passes more, which the join removes
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, table, blocks=blocks).collect()}
        hosts = [13 * n for n in range(len(urls))]
        assert got == {n: (f"h{i}.example/p{i % 7}/", "block") if i < 20_000 and i % 5 == i % 7 else (None, "allow") for n, i in enumerate(hosts)}
    keys = table.select(F.concat_ws("\n", "rule_host", "rule_path").alias("key"))
    blocks = url_filter.blocks_for(keys.count())
    test = url_filter.bloom_test(F.col("key"), url_filter.bloom_words(keys, "key", blocks), blocks)
    assert keys.where(~test).isEmpty()
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert others.where(test).count() < 600
    assert url_filter.blocks_for(0) == url_filter.blocks_for(5) == 16 and url_filter.blocks_for(10**9) == url_filter.MOST_BLOCKS


def test_urls_same_as_sql(spark, sf_dir, duck, same_rows):
    assert same_rows(QUERIES["op7_url_filter"](spark, sf_dir), duck, ORACLE["op7_url_filter"])


def test_one_id_on_two_texts(spark, docs, words):
    """Both texts of an id keep their links."""
    r = random.Random(12)
    a, b = ([r.choice(words) for _ in range(200)] for _ in range(2))
    near = lambda w: " ".join([*w[:-2], "other", "end"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (7, near(b)), (3, near(b) + " more"), (8, "alone here")]
    got = sorted((x.doc_id, x.n_links, x.component_id, x.kept) for x in jaccard_join.jaccard_join(docs(rows)).collect())
    assert got == [(3, 3, 3, True), (5, 1, 5, True), (5, 3, 3, False), (6, 1, 5, False), (7, 3, 3, False), (7, 3, 3, False), (8, 0, 8, True)]


def test_template_lines_take_linear_time(spark):
    """Lines of ten shared and two words of their own are no matches; four times as many take about four times as long at most."""
    import time

    took = {}
    for n in (10_000, 20_000, 40_000):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Dear reader of our page please find below the offer "), F.concat(F.lit("a"), F.col("id")), F.lit(" "), F.concat(F.lit("b"), F.col("id") * 7)).alias("text"))
        began = time.perf_counter()
        assert line_dedup.line_dedup(df).agg(F.sum(F.size("removed_lines"))).first()[0] == 0
        took[n] = time.perf_counter() - began
    assert took[40_000] < 4 * took[20_000] + 5 and took[40_000] < 60


def test_levels_come_from_tokens(spark):
    """Words are split and hashed once: levels are counted from the hashes, for every range, also one without words."""
    rows = [([5 << 46, 7 << 46],), ([5 << 46, (5 << 46) + 1],), ([-1],), ([],)]
    levels = spark.range(1).select(line_dedup.token_levels(spark.createDataFrame(rows, "tokens array<long>")).alias("v")).first().v
    assert len(levels) == line_dedup.RANGES and {i: v for i, v in enumerate(levels) if v} == {5: 6}


def test_only_wanted_lines_are_split_and_gone_lines_meet_none(spark):
    """Verification splits the lines that it asks for; a pair is left out by its later line alone, even within one document."""
    keyed = spark.createDataFrame([(1, "one two\nthree\n--\nfour")], "doc long, text string")
    every = {r["at"] >> 32: len(r.tokens) for r in line_dedup._lines(keyed).collect()}
    some = line_dedup._lines(keyed, F.shiftright("at", 32).isin(0, 2, 3)).collect()
    assert every == {0: 2, 1: 1, 3: 1} and {r["at"] >> 32: len(r.tokens) for r in some} == {0: 2, 3: 1}
    n, gone = 5 << 32, (5 + line_dedup.GONE) << 32
    rows = [(7, 1, 1, gone, 0, 0), (7, 1, 2, n, 0, 0), (7, 1, 3, gone, 0, 0), (7, 2, 0, n, 0, 0)]
    entries = spark.createDataFrame(rows, "token int, doc long, at long, meta long, map0 long, map1 long")
    got = {(r.doc, r["at"], r.h_doc, r.h_at) for r in line_dedup._pairs(entries, 4, 5).collect()}
    assert got == {(1, 2, 1, 1), (2, 0, 1, 1), (2, 0, 1, 2), (2, 0, 1, 3)}
