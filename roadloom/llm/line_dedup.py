"""Line dedup by an exact set-similarity join: prefix, length and positional filters, native throughout."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import forget, private, written

#: Token frequencies are counted in this many hash ranges; only the order of tokens depends on it.
RANGES = 1 << 18
#: Of so many rarest tokens, each pair is a key under which a line meets the earliest line alone, before all others.
HUB_TOKENS = 5
#: Lines under such a key, at least, that meet the earliest one first; fewer meet one another in the join of all.
CROWD = 16
#: Added to the length of a line that is gone; longer lines than this have more words than a Java array holds.
GONE = 1 << 30
#: Parts of the range of document ids in the order of lines; the last is of null ids.
PLACES = 1 << 20
#: Most bits of a filter of keys: 2 MB. It has at least 8 bits a key up to two million keys and passes more beyond.
MOST_BITS = 1 << 24
#: What an entry of a class under a token holds of its first line; a pair's later line and its earlier one.
SIDE, PAIR = ("doc", "at", "meta", "map0", "map1"), ("doc", "at", "h_doc", "h_at")
_LAST = 2**63 - 1  # stands for a null id


def line_tokens(line: Column) -> Column:
    """Hashes of a line's distinct words: runs of letters and digits, in lower case."""
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def literal_longs(values: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text): doc orders null ids last."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("doc"), F.col(f"`{text_col}`").alias("text"))


def _text_hash(text: str) -> Column:
    return F.xxhash64(text).bitwiseAND(0xFFFFFFFF)


def _lines(keyed: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(doc, at, tokens) of (doc, text): one row a line with words. at holds the line's number above the text's hash.

    wanted is a condition on doc and at: no other line is split into words.
    """
    parts = keyed.select("doc", _text_hash("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line", "words"))
    parts = parts.select("doc", F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("h")).alias("at"), "words")
    if wanted is not None:
        parts = parts.where(wanted)
    parts = parts.where(F.col("words").rlike(r"[\p{L}\p{N}]"))  # a filter on tokens would make them twice
    return parts.select("doc", "at", line_tokens(F.col("words")).alias("tokens"))


def token_levels(lines: DataFrame) -> Column:
    """For each of RANGES hash ranges of words, the number of lines with its words as four times its binary logarithm.

    lines holds tokens. The array has the same length whatever they are, and its strings are made on the executors.
    """
    seen = lines.select(F.explode("tokens").alias("h")).groupBy(F.shiftrightunsigned("h", 46).alias("r")).agg(F.count("*").alias("n"))
    every = lines.sparkSession.range(RANGES).select(F.col("id").alias("r")).join(seen, "r", "left")
    level = F.coalesce(F.floor(4 * F.log2(F.col("n"))), F.lit(0)).cast("int")
    runs = every.groupBy(F.expr("r div 1024").alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", level.alias("v")))), lambda x: x["v"].cast("string")), ",").alias("levels"))
    levels = ",".join(x.levels for x in sorted(runs.collect(), key=lambda x: x.run))
    return F.expr(f"cast(split('{levels}', ',') as array<tinyint>)")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs with n_lines and removed_lines (numbers from 0), and the text without those lines.

    A line goes if a line before it, by (doc_id, line number, hash of the text), has word sets with Jaccard >=
    threshold. Tokens are ordered by the frequency of their hash range over all texts, rare first; a line is
    found by its first n - ceil(threshold * n) + 1 tokens, and pairs must pass the length and positional
    filters and a bound from maps of token parities (128 bits) before their full sets are compared. Lines with equal sets (by two
    hashes and their size) are one class. Under pairs of its rarest tokens, a class is first compared with the
    earliest one; only classes that this leaves undecided meet all others, so thousands of near copies make a few
    pairs for each line; keys of fewer than CROWD lines are left to the join of all. A crowded token is one key of a
    sort-merge join, which adaptive execution splits; a crowded pair is one group of a window, 16 bytes a line.

    Defined cases: null text stays null; lines without letters or digits stay; a document may lose all lines and
    keeps its row; null ids come last; rows that repeat id and text get the same verdicts; an empty table gives
    no rows; extra columns stay whatever their names, but n_lines and removed_lines replace columns of these names.
    """
    t = Fraction(threshold).limit_denominator(1000)
    num, den = t.numerator, t.denominator
    keyed = _keyed(docs, id_col, text_col)
    # words are split and hashed once; both passes over all tokens read whole numbers
    hashed = written(_lines(keyed), "line-hashes")
    levels = token_levels(hashed)
    level = lambda h: F.get(levels, F.shiftrightunsigned(h, 46).cast("int")).cast("long")
    # never null, so that Spark sorts plain longs
    rank = lambda h: F.coalesce(F.shiftleft(level(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))
    n, n_prefix = F.size("tokens"), F.size("prefix")
    lines = hashed.select("doc", "at", F.sort_array(F.transform("tokens", rank)).alias("tokens")).select(
        "doc", "at", n.alias("n"), F.xxhash64("tokens").alias("class"), *[_parity(i).alias(f"map{i}") for i in (0, 1)],
        F.transform(F.slice("tokens", 1, (n - F.expr(f"(size(tokens) * {num} + {den} - 1) div {den}") + 1).cast("int")), lambda x: F.shiftrightunsigned(x, 7).bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefix"),
    )
    lines = written(lines, "lines")
    forget(hashed)
    same, maps = ["class", "n", "map0"], ["map0", "map1"]
    # a class's id begins with a coarse place in the order of documents, so that the smallest id of a crowd is an early line's
    low, high = keyed.where(F.col("doc") < _LAST).agg(F.min("doc").cast("double"), F.max("doc").cast("double")).first()
    place = F.when(F.col("doc") == _LAST, PLACES - 1).otherwise(F.floor((F.col("doc").cast("double") - (low or 0.0)) * ((PLACES - 2) / max(1.0, (high or 0.0) - (low or 0.0)))))
    class_id = F.shiftleft(place.cast("long"), 43).bitwiseOR(F.col("class").bitwiseAND((1 << 43) - 1))
    classes = lines.groupBy(*same).agg(F.min(F.struct("doc", "at", "map1", "prefix")).alias("f"), F.count("*").alias("times")).select(*same, "f.*", "times")
    classes = written(classes.withColumn("id", class_id), "line-classes")

    # near copies of thousands share pairs of rare tokens: each line first meets the earliest line under a few of these
    pairs_of_rare = F.array(*[F.when(n_prefix > j, F.xxhash64(F.get("prefix", F.lit(i)), F.get("prefix", F.lit(j)))) for j in range(HUB_TOKENS) for i in range(j)])
    asked = classes.select(F.explode(pairs_of_rare).alias("key"), "id").where("key is not null")
    crowd = Window.partitionBy("key")
    hubs = asked.withColumns({"x_id": F.min("id").over(crowd), "c": F.count("*").over(crowd)})
    near = written(hubs.where((F.col("c") >= CROWD) & (F.col("id") != F.col("x_id"))).select(F.col("id").alias("y_id"), "x_id").distinct(), "line-near")
    met = _both(near, classes).withColumns({f"{s}_meta": F.shiftleft(F.col(f"{s}_n").cast("long"), 32) for s in "yx"})
    y, x = ({c: F.col(f"{s}_{c}") for c in ("meta", *maps)} for s in "yx")
    gone = _verified(keyed, written(_later_first(met.where(_may_match(y, x, num, den))), "line-hubs"), num, den)
    forget(near)
    marked = classes.join(gone.withColumn("gone", F.lit(True)), ["doc", "at"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    marked = written(marked, "line-marked")
    forget(classes)

    # what these don't decide meets all others under the first tokens; of two lines the shorter one needs fewer of them
    entries = marked.select(F.posexplode("prefix").alias("pos", "token"), "doc", "at", "n", *maps, "gone")
    entries = entries.select("token", "doc", "at", F.shiftleft((F.col("n") + F.when(F.col("gone"), GONE).otherwise(0)).cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("meta"), *maps, (F.col("pos") < F.col("n") - _least(F.col("n"), num, den) + 1).alias("short"))
    own = ("token", *SIDE)
    # said here, so that Spark adds it to no side of the joins and one exchange serves three of the four
    for c in (*map(F.col, own), length({"meta": F.col("meta")}).cast("int")):
        entries = entries.where(c.isNotNull())
    alike, longer = entries.where("short").select(*own), entries.where("not short").select(*own)
    met = _pairs(alike, num, den).unionByName(_pairs_with_shorter(longer, alike, num, den))
    met = met.groupBy(*PAIR, "y_n", "x_n").agg(F.count("*").alias("shared"))
    # the count of shared first tokens bounds the overlap
    need = F.ceil((F.col("y_n") + F.col("x_n")) * num / (num + den) - 1e-9)
    short, long = F.least("y_n", "x_n"), F.greatest("y_n", "x_n")
    behind = F.greatest(_least(short, num, den), F.when(short == long, 0).otherwise(F.floor((long * num + den - 1) / den))) - 1
    pairs = written(met.where(F.col("shared") >= need - behind).select(*PAIR), "line-pairs")
    gone = gone.unionByName(_verified(keyed, pairs, num, den)).distinct()

    # a class that an earlier line matches goes wholly; else all but its first line
    verdict = marked.join(gone.withColumn("all", F.lit(True)), ["doc", "at"], "left").where("all or times > 1").select(*same, F.col("doc").alias("f_doc"), F.col("at").alias("f_at"), F.coalesce("all", F.lit(False)).alias("all"))
    removed = lines.select("doc", "at", *same).join(verdict, same).where("all or doc <> f_doc or at <> f_at")
    m = private(*docs.columns)
    per_doc = removed.groupBy(F.col("doc").alias(f"{m}doc"), F.col("at").bitwiseAND(0xFFFFFFFF).alias(f"{m}hash")).agg(F.array_sort(F.collect_set(F.shiftrightunsigned("at", 32).cast("int"))).alias(f"{m}removed"))
    per_doc = written(per_doc, "line-removed")
    forget(marked, lines)
    return _without_lines(docs, per_doc, m, id_col, text_col)


def _least(n: Column, num: int, den: int) -> Column:
    """Tokens that a line of n tokens shares with one that it matches and that isn't shorter, at least."""
    return F.floor((2 * num * n + num + den - 1) / (num + den))


def _both(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (y_id, x_id) with what both classes are."""
    side = lambda s: classes.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "map0", "map1")], F.struct("doc", "at").alias(f"{s}_f"))
    return met.join(side("y"), "y_id").join(side("x"), "x_id")


def _later_first(both: DataFrame) -> DataFrame:
    """(doc, at, h_doc, h_at): the first line of the later class of a pair, and that of the earlier."""
    rows = both.select(F.greatest("y_f", "x_f").alias("f"), F.least("y_f", "x_f").alias("h"))
    return rows.select("f.doc", "f.at", F.col("h.doc").alias("h_doc"), F.col("h.at").alias("h_at")).distinct()


def _without_lines(docs: DataFrame, per_doc: DataFrame, m: str, id_col: str, text_col: str) -> DataFrame:
    """docs without the lines of per_doc (doc, hash, removed under private names)."""
    text, split = F.col(f"`{text_col}`"), F.split(f"`{text_col}`", "\n")
    out = docs.withColumns({f"{m}doc": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)), f"{m}hash": _text_hash(f"`{text_col}`"), f"{m}lines": F.when(text.isNull(), 0).otherwise(F.size(split))}).join(per_doc, [f"{m}doc", f"{m}hash"], "left")
    removed = F.col(f"{m}removed")
    kept = F.when(removed.isNull(), text).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains(removed, i)), "\n"))
    cols = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "removed_lines")]
    return out.select(*cols, F.col(f"{m}lines").alias("n_lines"), F.coalesce(removed, F.array().cast("array<int>")).alias("removed_lines"))


def _parity(half: int) -> Column:
    """64 bits, each the parity of the number of tokens that fall on it; half of the tokens, by one bit, belong to each map.

    A token that only one of two sets holds turns one bit, so differing bits bound differing tokens.
    """
    bits = literal_longs([(1 << i % 64) - (1 << 64) * (i % 64 == 63) if i // 64 == half else 0 for i in range(128)])
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda m, x: m.bitwiseXOR(F.get(bits, x.bitwiseAND(127).cast("int"))))


def length(s: dict[str, Column]) -> Column:
    return F.shiftrightunsigned(s["meta"], 32).bitwiseAND(GONE - 1)


def _may_match(y: dict[str, Column], x: dict[str, Column], num: int, den: int) -> Column:
    """Length and positional filters, and a bound on differing tokens from the bits of the two maps."""
    ny, nx = length(y), length(x)
    py, px = (s["meta"].bitwiseAND(0xFFFFFFFF) for s in (y, x))
    total = ny + nx
    need = F.ceil(total * num / (num + den) - 1e-9)
    apart = F.bit_count(y["map0"].bitwiseXOR(x["map0"])) + F.bit_count(y["map1"].bitwiseXOR(x["map1"]))
    return (ny * den >= nx * num) & (nx * den >= ny * num) & (F.least(ny - py, nx - px) + F.least(py, px) >= need) & (apart <= total - 2 * need)


def _pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes under a token that pass the filters, unless the later is gone; a row for each shared token.

    A match no shorter than a line shares one of its first n - _least(n) + 1 tokens, so that lines of a template whose own
    words are rarer than the template's don't meet at all.

    Both sides are one table, so that one exchange serves both; a filter of one side alone would make it two.
    """
    y, x, both = _sides(entries, entries)
    stays = _stays(y) | (y["doc"] < x["doc"])  # with both sides in it, as Spark would filter y alone
    met = both(_before(x, y) & stays & _may_match(y, x, num, den))
    return met.select(y["doc"].alias("doc"), y["at"].alias("at"), x["doc"].alias("h_doc"), x["at"].alias("h_at"), length(y).cast("int").alias("y_n"), length(x).cast("int").alias("x_n"))


def _pairs_with_shorter(longer: DataFrame, entries: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of _pairs() that a longer line finds by its further tokens among the first ones of shorter lines."""
    y, x, both = _sides(longer, entries)
    later = _before(x, y)
    met = both((length(x) < length(y)) & F.when(later, _stays(y)).otherwise(_stays(x)) & _may_match(y, x, num, den))
    first = lambda p, q: F.when(later, p).otherwise(q)
    return met.select(first(y["doc"], x["doc"]).alias("doc"), first(y["at"], x["at"]).alias("at"), first(x["doc"], y["doc"]).alias("h_doc"), first(x["at"], y["at"]).alias("h_at"), first(length(y), length(x)).cast("int").alias("y_n"), first(length(x), length(y)).cast("int").alias("x_n"))


def _sides(left: DataFrame, right: DataFrame) -> tuple[dict[str, Column], dict[str, Column], Callable[[Column], DataFrame]]:
    """Columns of entries y and x, and their join under one token where a condition holds."""
    a, b = (df.select(*[F.col(c).alias(f"{s}_{c}") for c in ("token", *SIDE)]) for s, df in (("y", left), ("x", right)))
    y, x = ({c: F.col(f"{s}_{c}") for c in SIDE} for s in "yx")
    return y, x, lambda holds: a.join(b, (F.col("y_token") == F.col("x_token")) & holds)


def _before(x: dict[str, Column], y: dict[str, Column]) -> Column:
    return (x["doc"] < y["doc"]) | ((x["doc"] == y["doc"]) & (x["at"] < y["at"]))


def _stays(s: dict[str, Column]) -> Column:
    return s["meta"] < GONE << 32


def bloom(keys: DataFrame, key: str, col: Column) -> Column:
    """May col be among the keys? Always true for those that are. Bits are 8 a key, MOST_BITS at most."""
    n = keys.count()
    bits = min(MOST_BITS, max(1 << 12, 1 << (8 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = place(F.col(key))
    words = {r.w: r.v for r in keys.groupBy(F.floor(bit / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("v")).collect()}
    table = literal_longs([words.get(i, 0) for i in range(bits // 64)])
    return F.call_function("getbit", F.get(table, F.floor(place(col) / 64).cast("int")), (place(col) % 64).cast("int")) == 1


def _verified(keyed: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The later lines (doc, at) of the written pairs whose full token sets have Jaccard >= num / den; the pairs' files go."""
    # a document's text is split only if the filter passes it, and a line's words only if it passes the line too
    some = keyed.where(bloom(pairs.select(F.explode(F.array("doc", "h_doc")).alias("doc")).distinct(), "doc", F.col("doc")))
    wanted = pairs.select(F.explode(F.array(F.struct("doc", "at"), F.struct(F.col("h_doc").alias("doc"), F.col("h_at").alias("at")))).alias("k")).select("k.*").distinct()
    asked = bloom(wanted.select(F.xxhash64("doc", "at").alias("k")), "k", F.xxhash64("doc", "at"))
    sets = written(_lines(some, asked).join(wanted, ["doc", "at"], "left_semi").dropDuplicates(["doc", "at"]), "line-sets")
    both = pairs.join(sets, ["doc", "at"]).withColumnRenamed("tokens", "y").join(sets.select(F.col("doc").alias("h_doc"), F.col("at").alias("h_at"), F.col("tokens").alias("x")), ["h_doc", "h_at"])
    shared = F.size(F.array_intersect("x", "y"))
    true = written(both.where(shared * den >= (F.size("x") + F.size("y") - shared) * num).select("doc", "at").distinct(), "line-gone")
    forget(sets, pairs)
    return true
