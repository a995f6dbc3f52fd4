"""The Merkle manifest against plain trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from roadloom.llm import merkle
from roadloom.llm.queries import ORACLE, QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def plain(rows, fanout, bump=lambda r: r):
    """(id, leaf) -> (group, position, subroot, root, siblings, folded root)."""
    by = {}
    leaf = lambda r: sha("".join(enc(r[c]) for c in merkle.FIELDS))
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(bump(r))))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(by[g])], fanout) for g in groups}
    top = levels([trees[g][-1][0] for g in groups], fanout)
    out = []
    for k, g in enumerate(groups):
        for pos, (has, i, x, changed) in enumerate(sorted(by[g])):
            beside, folded = [], changed
            for tree, at in ((trees[g], pos), (top, k)):
                for level in tree[:-1]:
                    first = at // fanout * fanout
                    run = level[first : first + fanout]
                    beside += [v for j, v in enumerate(run) if first + j != at]
                    folded = sha("".join(folded if first + j == at else v for j, v in enumerate(run)))
                    at //= fanout
            out.append((i if has else None, x, g, pos, trees[g][-1][0], top[-1][0], "".join(beside), folded))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.leaf, r.group, r.position, r.subroot, r.root, r.siblings, r.folded_root) for r in df.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, key int"


def made(spark, n=1000):
    langs = ["en"] * 7 + ["de", "é", None]
    rows = [(i * 3, f"text {i}\nü", langs[i % 10], f"s{i % 4}", i, "clash", 1) for i in range(n)]
    rows += [(1, "", "one", None, None, "clash", 2), (None, None, None, None, None, None, 3), (None, "x", "en", "s", 9, None, 4), (6, "other text", "en", "s", 1, None, 5), (6, "text 2\nü", "en", "s2", 2, None, 5), (4, "long " * 200_000, "z", "s", 2**63 - 1, None, 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_same_as_plain_trees(spark, fanout):
    df = made(spark)
    rows = [r.asDict() for r in df.collect()]
    bump = lambda r: r | {"n_chars": r["n_chars"] + 1} if r["doc_id"] and r["doc_id"] % 2 and r["n_chars"] is not None else r
    n = F.col("n_chars").cast("decimal(20,0)")
    got = merkle.merkle_manifest(df, fanout=fanout, tampered={"n_chars": F.when(F.col("doc_id") % 2 == 1, n + 1).otherwise(n)})
    assert result(got) == plain(rows, fanout, bump)


def test_every_change_of_a_leaf_is_found_and_no_other(spark):
    df = made(spark, 200)
    got = merkle.merkle_manifest(df, tampered={"text": F.when(F.col("doc_id") == 30, F.lit("forged")).otherwise(F.col("text"))}).collect()
    assert {r.doc_id for r in got if r.folded_root != r.root} == {30}
    assert all(r.folded_root == r.root for r in merkle.merkle_manifest(df).collect())


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(empty).collect() == []
    one = spark.createDataFrame([(5, "t", None, None, 1, None, None)], SCHEMA)
    r = merkle.merkle_manifest(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.siblings == "" and r.group is None
    twice = one.union(one)
    rows = merkle.merkle_manifest(twice).collect()
    assert [r.position for r in sorted(rows, key=lambda r: r.position)] == [0, 1] and {r.subroot for r in rows} == {sha(r.leaf * 2)}
    with pytest.raises(ValueError):
        merkle.merkle_manifest(one, fanout=1)


def test_op13_same_as_sql_and_same_as_plain(spark, duck, sf_dir, same_rows):
    df = QUERIES["op13_merkle"](spark, sf_dir)
    assert same_rows(df, duck, ORACLE["op13_merkle"]) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = df.collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)
