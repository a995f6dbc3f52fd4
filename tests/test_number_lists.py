"""Lists of numbers in texts: numbers of any length, and texts that are missing."""

import duckdb
import pytest

from roadloom.functions import scalars
from roadloom.plans.queries import ORACLE, QUERIES

LONG = "909955422195631329054"


@pytest.mark.parametrize("name", ["parse_int_list", "parse_float_list"])
def test_long_numbers_and_missing_texts_count_as_in_sql(spark, same_rows, tmp_path, name):
    rows = [(1, f"a 12, -3 and {LONG}"), (2, None), (3, ""), (4, f"-{LONG}{LONG}.5"), (5, "9223372036854775807 -9223372036854775808 9223372036854775808")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert same_rows(QUERIES[name](spark, str(tmp_path)), con, ORACLE[name]) == 5


def test_a_number_beyond_64_bits_keeps_its_place(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(scalars.ints_in(F.lit(f"[12, {LONG}, -9223372036854775808]")).alias("v")).first().v
    assert got == [12, None, -9223372036854775808]
