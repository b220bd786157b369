"""Queries that once did less than their whole job."""

import pytest
from pyspark.sql import functions as F

from lodestone import sinks
from lodestone.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_sorted_files_give_their_rows(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice")
    got = QUERIES["src_sst"](spark, SF)
    assert got.columns == ["o_orderkey", "o_totalprice"] and sorted(got.collect()) == sorted(orders.collect())
    assert "count(" not in ORACLE["src_sst"]
    empty = sinks.verified_rows(orders.limit(0), str(tmp_path / "s"), "o_orderkey", 4)
    assert empty.count() == 0


def test_files_out_of_order_raise(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 100, 1, 2).select((F.lit(99) - F.col("id")).alias("k"))
    monkeypatch.setattr(sinks, "sorted_files", lambda df, path, key, files: df.write.parquet(path))
    with pytest.raises(Exception, match="not sorted"):
        sinks.verified_rows(rows, str(tmp_path / "s"), "k", 2).collect()


def test_every_day_has_its_file(spark):
    want = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("ds"))
    assert sorted(QUERIES["snk_daily_csv"](spark, SF).select("o_orderkey", "ds").collect()) == sorted(want.collect())
