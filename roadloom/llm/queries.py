"""The queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import embedding_dedup, hard_negatives, importance, jaccard_join, line_dedup, merkle, mixing, packing, suffix_dedup, suffix_tree, topk_search, toxicity, url_filter
from roadloom.llm.common import id_crc32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go, of every document; the operator itself also returns the text that stays."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines")


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", noisy))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and what it folds to where n_chars was changed."""
    n = F.col("n_chars").cast("decimal(20,0)")
    changed = F.when(F.pmod(id_crc32("doc_id"), F.lit(7)) == 0, n + 1).otherwise(n)
    out = merkle.merkle_manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": changed})
    return out.select("doc_id", "leaf", "subroot", "root", merkle.digest("siblings").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_embedding_dedup, op3_suffix_dedup, op4_topk_search, op5_line_dedup, op6_importance, op7_url_filter, op8_toxicity, op9_mixing, op10_jaccard_join, op11_suffix_tree, op12_hard_negatives, op13_merkle)}

ORACLE: dict[str, str] = {
    "op7_url_filter": r"""
with rules(action, rule_host, rule_path) as (values ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from r),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
u as (select distinct host, path from p),
m as (select host, path, rule_host || rule_path as rule, action, row_number() over (partition by host, path order by length(rule_host || rule_path) desc, length(rule_host) desc) as k
      from u join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, p.host, p.path, rule, coalesce(action, 'allow') as verdict from p left join m on p.host = m.host and p.path = m.path and k = 1""",
    "op4_topk_search": r"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as t from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.t as double[]), cast(c.t as double[])) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
k as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from k where rank <= 20""",
    "op12_hard_negatives": r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as t from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_dot_product(cast(a.t as double[]), cast(c.t as double[])) as bigint) as score from v a join v c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, cast(row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as integer) as rank
      from p join s using (anchor_id) where not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    # crc32 bit by bit over the digits; the trees level by level, the groups' first, then that of their roots
    "op13_merkle": r"""
with recursive d as (
  select doc_id, lang, n_chars, concat(coalesce(concat(strlen(cast(doc_id as varchar)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-')) as head,
         coalesce(concat(strlen(text), ':', text), '-') as tail,
         coalesce(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
           lambda a, c: list_reduce(list_concat([xor(a, c)], [cast(0 as bigint), 0, 0, 0, 0, 0, 0, 0]), lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 0) as crc from documents),
l as (select doc_id, lang, sha256(concat(head, coalesce(concat(strlen(cast(n_chars as varchar)), ':', n_chars), '-'), tail)) as leaf,
        n_chars is not null and doc_id is not null and xor(crc, 4294967295) % 7 = 0 as hit,
        sha256(concat(head, coalesce(concat(strlen(cast(cast(n_chars as hugeint) + 1 as varchar)), ':', cast(n_chars as hugeint) + 1), '-'), tail)) as other from d),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from l),
t as (
  select 0 as level, lang, pos, leaf as h, count(*) over (partition by lang) as n from p
  union all
  select level + 1, lang, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from t where n > 1 group by level, lang, pos // 2),
s as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as place from t where n = 1),
g as (
  select 0 as level, place as pos, subroot as h, count(*) over () as n from s
  union all
  select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from g where n > 1 group by level, pos // 2),
f as (
  select 0 as level, p.doc_id, p.lang, p.pos, p.leaf, p.pos as node, case when hit then other else leaf end as h, '' as proof, subroot, place, false as above, (select max(n) from t where t.level = 0 and t.lang is not distinct from p.lang) as n from p join s on s.lang is not distinct from p.lang
  union all
  select case when n > 1 then f.level + 1 else 0 end, doc_id, f.lang, f.pos, leaf, case when n > 1 then node // 2 else place end,
    case when n > 1 then sha256(case when x.h is null then f.h when node % 2 = 0 then concat(f.h, x.h) else concat(x.h, f.h) end) else f.h end, concat(proof, coalesce(x.h, '')), subroot, place, above or n = 1,
    case when n > 1 then (n + 1) // 2 else (select max(n) from g where g.level = 0) end
  from f left join (select false as above2, level as level2, lang as lang2, pos as pos2, h from t union all select true, level, null, pos, h from g) x
    on n > 1 and above2 = f.above and level2 = f.level and pos2 = xor(f.node, 1) and (f.above or lang2 is not distinct from f.lang)
  where n > 1 or not above)
select doc_id, leaf, subroot, (select h from g where n = 1) as root, sha256(proof) as proof_sha256, h as folded_root, h = (select h from g where n = 1) as verified from f where above and n = 1""",
}
