"""A training-data pipeline of five operators over the documents table.

Run on a cluster as `run(spark, sf_dir)`; each stage's result is written as Parquet to the shared folder and read
again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from roadloom.llm.common import forget, scratch, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go.

    Null and empty texts, null ids and repeated rows stay or go by their text alone; no documents give none.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document keeps its row, and n_chars follows the text.

    Null texts stay null, with the n_chars that they have; a text may become empty; other columns stay as they are.
    """
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Rows that repeat both id and text become one; rows of one id with other texts share their fate. Null and empty
    texts and null ids have no copies and stay; ties can't be, as ids decide.
    """
    gone = jaccard_join.jaccard_join(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs.doc_id == gone._gone, "left_anti")
    often = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_often")).count().where("count > 1").select("_often"), "pipeline-repeated")
    if often.isEmpty():
        return left
    once = left.join(often, left.doc_id == often._often, "left_anti")
    return once.unionByName(left.join(often, left.doc_id == often._often, "left_semi").dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them; texts without words, null ones too, are never read."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; empty and null texts are one token, null ids stay null."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenizer ids and learned scores aren't expressible in SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; intermediate tables go as soon as the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        with scratch():
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if last is not None:
            forget(last)
        last = docs
    return docs
