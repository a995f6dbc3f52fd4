"""URL filter: a blocked Bloom filter of the listed rules, then an exact join of what may hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit words in a block, and bits set for each key.
BLOCK_WORDS, BITS = 4, 6
#: Bits of the filter for each rule, and the most blocks: 2 MB. Beyond 1.4 million rules it passes more, which the join removes.
BITS_A_RULE, MOST_BLOCKS = 12, 1 << 16
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host ends at `/`, `?`, `#`, its A-Z are lower-cased; the path ends at `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64 * BLOCK_WORDS)).cast("int")


def blocks_for(n: int) -> int:
    """Blocks of a filter of n keys: a power of two with at least BITS_A_RULE bits a key, MOST_BLOCKS at most."""
    wanted = -(-n * BITS_A_RULE // (64 * BLOCK_WORDS))
    return min(MOST_BLOCKS, 1 << max(4, (wanted - 1).bit_length()))


def bloom_words(keys: DataFrame, key: str, blocks: int) -> list[int]:
    """The filter's 64-bit words, blocks * BLOCK_WORDS of them whatever the number of keys.

    All bits of a key lie in one block of 256 bits. Built by a grouped bit_or; only the words come to the driver.
    """
    k = F.col(key)
    bits = keys.select(F.explode(F.array(*[_block(k, blocks) * 64 * BLOCK_WORDS + _bit(k, i) for i in range(BITS)])).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("w")).collect()
    out = [0] * (blocks * BLOCK_WORDS)
    for r in words:
        out[r.word] = r.w
    return out


def bloom_test(key: Column, words: list[int], blocks: int) -> Column:
    """May the key be listed? False means it isn't."""
    table = F.expr(f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)")
    hit = F.lit(True)
    for i in range(BITS):
        bit = _bit(key, i)
        word = F.get(table, _block(key, blocks) * BLOCK_WORDS + F.floor(bit / 64).cast("int"))
        hit = hit & (F.call_function("getbit", word, bit % 64) == 1)
    return hit


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", blocks: int | None = None) -> DataFrame:
    """A verdict for every url.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule
    (host and path; on equal length the longer host, then block) decides, else `default`. Each url gives a
    key for every pair of a host suffix and a path prefix of a length that some rule has; keys that pass
    the Bloom filter, whose size follows the number of rules unless `blocks` is given, are joined exactly with
    the rules, so false hits go. A-Z of rule hosts count as lower case, as in urls.
    The distinct lengths of rule paths are collected; they are few whatever the number of rules.

    Defined cases: null urls and urls without `://` have empty host and path and get the default; an empty
    host fits no rule; null or empty rules tables let all pass with the default; repeated rules count once;
    repeated urls and ids get a row each; other columns are dropped.
    """
    host, path = split_url(F.col(url_col))
    clean = rules.where("rule_host is not null and rule_path is not null and action is not null").select("action", lower_ascii(F.col("rule_host")).alias("rule_host"), "rule_path")
    clean = clean.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))  # block over allow
    keyed = clean.select("action", "rule_host", "rule_path", F.concat_ws("\n", "rule_host", "rule_path").alias("key"))
    lengths = sorted(r[0] for r in clean.select(F.length("rule_path")).distinct().collect())
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("_row", F.struct("host", "path"))
    if not lengths:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # distinct (host, path) pairs are judged once
    pairs = base.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    keys = pairs.select("host", "path", F.explode(suffixes).alias("_suffix")).select("host", "path", "_suffix", F.explode(cuts).alias("_cut")).select("host", "path", F.concat_ws("\n", "_suffix", F.expr("substring(path, 1, _cut)")).alias("key"))
    blocks = blocks or blocks_for(keyed.count())
    words = bloom_words(keyed, "key", blocks)
    hits = keys.where(bloom_test(F.col("key"), words, blocks)).join(keyed, "key")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "action"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("best"))
    return base.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
