"""Row numbers over tables of many partitions."""

import pytest
from pyspark.sql import functions as F

from seguelab.operators import relations as R

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("adaptive, partitions", [("true", "8"), ("true", "200"), ("false", "8")])
def test_numbers_have_no_gap(spark, adaptive, partitions):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.read.parquet(f"{SF}/lineitem.parquet")
        n = rows.count()
        got = R.number_rows(rows, [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).agg(F.count("*").alias("n"), F.count_distinct("row_idx").alias("d"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"), F.sum("l_quantity").alias("q")).first()
        assert (got.n, got.d, got.lo, got.hi) == (n, n, 0, n - 1) and n == 600_000
        assert got.q == rows.agg(F.sum("l_quantity")).first()[0]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_numbers_follow_the_keys(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet")
    got = R.number_rows(rows, [-F.col("o_totalprice"), F.col("o_orderkey")], start=1).select("o_orderkey", "o_totalprice", "row_idx").toPandas().sort_values("row_idx")
    want = rows.select("o_orderkey", "o_totalprice").toPandas().sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True])
    assert got["o_orderkey"].tolist() == want["o_orderkey"].tolist() and got["row_idx"].tolist() == list(range(1, len(want) + 1))


def test_one_key_for_all_rows_and_none_at_all(spark):
    same = spark.range(5000).select(F.lit("x").alias("k"), F.lit(1).alias("v")).union(spark.createDataFrame([(None, None)] * 3, "k string, v int"))
    got = R.number_rows(same, [F.col("k")]).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(5003)) and [r.k for r in got[:4]] == [None, None, None, "x"]
    assert R.number_rows(same.limit(0), [F.col("k")]).count() == 0
