"""Nearest word of a dictionary: a join on letters, then the exact ratio of the pairs that are left."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from roadloom.functions.scalars import letters


def letter_tokens(word: Column) -> Column:
    """A word's letters, each with how often it has come so far, in one order for all words: repeated letters first.

    They are distinct, so the letters that two words share, as often as both have them, are the tokens they share.
    """

    def token(i: Column) -> Column:
        letter, until = F.substring(word, i, F.lit(1)), F.substring(word, F.lit(1), i)
        return F.struct((F.length(until) - F.length(F.replace(until, letter, F.lit("")))).alias("k"), letter.alias("c"))

    tokens = F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), token)).otherwise(F.array().cast("array<struct<k:int,c:string>>"))
    return F.sort_array(tokens, asc=False)


def _side(words: DataFrame, mark: str, cutoff: float) -> DataFrame:
    """Words with their tokens and the first of these, one of which a word with that ratio must share."""
    n = F.col(f"{mark}_n")
    made = words.withColumn(f"{mark}_tokens", letter_tokens(F.col(mark))).withColumn(f"{mark}_n", F.length(mark))
    return made.withColumn("token", F.explode(F.slice(f"{mark}_tokens", F.lit(1), (n - F.ceil(n * (cutoff / (2 - cutoff)) - 1e-9) + 1).cast("int"))))


@F.pandas_udf(DoubleType())
def ratio(word: pd.Series, text: pd.Series) -> pd.Series:
    """difflib's ratio of a word of the dictionary and a text."""
    return pd.Series([difflib.SequenceMatcher(None, w, t).ratio() for w, t in zip(word, text)], dtype=float)


def fuzzy_match(texts: DataFrame, words: DataFrame | list[str], col: str = "text", cutoff: float = 0.6) -> DataFrame:
    """texts with `matched`: the dictionary's nearest word by difflib's ratio, or the text's letters in lower case.

    words: the dictionary, a list or a table's column `name`. A ratio of cutoff needs so many letters in common that two words
    share one of their first tokens; pairs meet under these, and the letters in common bound the ratio, which is
    worked out for what is left alone. Texts that are alike are matched once. Of equal ratios the last word by
    name wins. Null texts stay null; texts without letters match nothing.
    """
    spark = texts.sparkSession
    if not isinstance(words, DataFrame):
        words = spark.createDataFrame([(w,) for w in words], "name string")
    known = words.select(F.lower(F.trim("name")).alias("w")).where("w <> ''").distinct()
    asked = texts.select(letters(F.col(col)).alias("t")).where("t <> ''").distinct()
    a, b = _side(known, "w", cutoff), _side(asked, "t", cutoff)
    fit = F.least("w_n", "t_n") * 2.0 / (F.col("w_n") + F.col("t_n")) >= cutoff
    met = a.join(b, "token").where(fit).dropDuplicates(["w", "t"])
    near = met.where(F.size(F.array_intersect("w_tokens", "t_tokens")) * 2.0 / (F.col("w_n") + F.col("t_n")) >= cutoff)
    sure = near.select("w", "t", ratio("w", "t").alias("r")).where(F.col("r") >= cutoff)
    best = sure.groupBy("t").agg(F.max(F.struct("r", "w"))["w"].alias("w"))
    own = "_"
    while any(c.startswith(own) for c in texts.columns):
        own += "_"
    named = best.select(F.col("t").alias(f"{own}t"), F.col("w").alias(f"{own}w"))
    keyed = texts.withColumn(f"{own}bare", letters(F.col(col)))
    out = keyed.join(named, F.col(f"{own}bare") == F.col(f"{own}t"), "left")
    return out.withColumn("matched", F.coalesce(f"{own}w", f"{own}bare")).drop(f"{own}bare", f"{own}t", f"{own}w")
