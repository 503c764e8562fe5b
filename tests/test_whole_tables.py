"""Queries that must meet every row of their table."""

import pytest
from pyspark.sql import functions as F

from keystrata import operators


@pytest.mark.parametrize("name, times", [("load_cell_merge", 1), ("load_nulls", 2)])
def test_loads_take_every_order(spark, sf_dir, name, times):
    assert operators.QUERIES[name](spark, sf_dir).count() == times * spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_join_and_udf_meet_every_order(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    joined = operators.QUERIES["keyed_join"](spark, sf_dir).agg({"n": "sum"}).first()[0]
    assert joined == orders.join(spark.read.parquet(f"{sf_dir}/customer.parquet"), orders.o_custkey == F.col("c_custkey")).count()
    assert operators.QUERIES["udf_in_where"](spark, sf_dir).count() == orders.where("o_custkey * 2 > 100").count()
