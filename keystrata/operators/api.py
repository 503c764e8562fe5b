"""Operators reached through the DataFrame API: sources, functions of Python, hidden columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import scratch
from .relational import lenient


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _udfs(spark: SparkSession) -> SparkSession:
    """Vectorised functions, registered by name."""
    session = lenient(spark)
    session.udf.register("double_it", F.pandas_udf(lambda v: v * 2, T.LongType()))
    session.udf.register("initial", F.pandas_udf(lambda v: v.str[:1], T.StringType()))
    return session


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _udfs(spark)
    _table(s, sf_dir, "orders").createOrReplaceTempView("orders")
    return s.sql("SELECT o_orderkey, double_it(o_custkey) AS twice FROM orders")


def udf_in_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A UDF alone decides which orders stay."""
    s = _udfs(spark)
    _table(s, sf_dir, "orders").createOrReplaceTempView("orders")
    return s.sql("SELECT o_orderkey FROM orders WHERE double_it(o_custkey) > 100")


def udf_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _udfs(spark)
    _table(s, sf_dir, "customer").createOrReplaceTempView("customer")
    return s.sql("SELECT initial(c_mktsegment) AS i, count(*) AS n FROM customer GROUP BY initial(c_mktsegment)")


def dsl_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.where(F.col("o_totalprice") > 1000).orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(20)


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with an inferred schema."""
    s = lenient(spark)
    path = scratch(s, "json")
    _table(s, sf_dir, "events").select(F.to_json(F.struct("event_id", F.struct("event_type", "user_id").alias("who"), F.array("value").alias("values"))).alias("value")).write.text(path)
    s.read.json(path).createOrReplaceTempView("lines")
    return s.sql("SELECT who.event_type AS event_type, count(*) AS n, round(sum(values[0]), 4) AS total FROM lines GROUP BY who.event_type")


def parquet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet written here, joined with a table."""
    s = lenient(spark)
    path = scratch(s, "parquet")
    _table(s, sf_dir, "nation").where("n_nationkey < 10").write.parquet(path)
    return s.read.parquet(path).join(_table(s, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an explicit nested schema and column metadata, as a temporary view."""
    schema = T.StructType(
        [
            T.StructField("id", T.IntegerType(), False, {"note": "kept"}),
            T.StructField("s", T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.BooleanType())])),
            T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
        ]
    )
    s = lenient(spark)
    s.createDataFrame([(1, (10, True), {"a": 5}), (2, (20, False), {"b": 6}), (3, None, None)], schema).createOrReplaceTempView("held")
    return s.sql("SELECT id, s.x AS x, s.y AS y, m['a'] AS a FROM held")


def rand_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose values hang on where a row lies."""
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.rand(5).alias("r"), F.randn(5).alias("g"), F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("part"))


def set_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET k = v, SET k, and SET of what isn't defined."""
    s = lenient(spark)
    s.sql("SET keystrata.test = 7")
    return s.sql("SET keystrata.test").union(s.sql("SET keystrata.missing"))


QUERIES = {f.__name__: f for f in (udf_scalar, udf_in_where, udf_group_by, dsl_chain, json_source, parquet_source, local_rows, rand_ids, set_conf)}
ORACLES = {
    "udf_scalar": "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders",
    "udf_in_where": "SELECT o_orderkey FROM orders WHERE o_custkey * 2 > 100",
    "udf_group_by": "SELECT substr(c_mktsegment, 1, 1) AS i, count(*) AS n FROM customer GROUP BY 1",
    "dsl_chain": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "json_source": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "parquet_source": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 10",
    "local_rows": "SELECT * FROM (VALUES (1, 10, true, 5), (2, 20, false, NULL), (3, NULL, NULL, NULL)) t(id, x, y, a)",
    "set_conf": "SELECT * FROM (VALUES ('keystrata.test', '7'), ('keystrata.missing', '<undefined>')) t(key, value)",
}
