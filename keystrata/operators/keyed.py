"""Operators of keyed tables: statements, loads, upserts, scans by key, and layouts without shuffles.

Read-only queries share one copy of a table for each input folder, made when first asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.predicates import key
from ..plans.statements import parse
from ..session import KeyedSession
from ..sources.files import scratch
from ..sources.provider import register

ORDERS = "(o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string, PRIMARY KEY (o_orderkey)) MAPPED BY (orders_store, COLS=[o_custkey=a.cust, o_orderstatus=a.status, o_totalprice=b.price, o_orderpriority=b.priority])"
EVENTS = "(user_id bigint, event_id bigint, event_type string, value double, PRIMARY KEY (user_id, event_id)) MAPPED BY (events_store, COLS=[event_type=e.kind, value=e.value])"
COLUMNS = {
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority",
    "events": "user_id, event_id, event_type, value",
}
REGIONS = 8
_shared: dict[tuple[str, str, str], KeyedSession] = {}


def fresh(spark: SparkSession, sf_dir: str) -> KeyedSession:
    """A session without tables, and the inputs as views named src_…"""
    s = KeyedSession(spark, scratch(spark))
    for name in ("orders", "events", "nation", "region", "customer"):
        s.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"src_{name}")
    return s


def shared(spark: SparkSession, sf_dir: str, what: str) -> KeyedSession:
    """The keyed copy of orders or events, split into regions of equal key width."""
    at = (spark.sparkContext.applicationId, sf_dir, what)
    held = _shared.get(at)
    if held is not None and held.storage.manifest(held.catalog.get(f"{what}_k")) is not None:
        return held
    s = fresh(spark, sf_dir)
    name, text = f"{what}_k", ORDERS if what == "orders" else EVENTS
    lead = "o_orderkey" if what == "orders" else "user_id"
    low, high = s.spark.sql(f"SELECT coalesce(min({lead}), 0), coalesce(max({lead}), 0) FROM src_{what}").first()
    splits = sorted({low + (high - low) * i // REGIONS for i in range(1, REGIONS)} - {low})
    s.create(parse(f"CREATE TABLE {name} {text}"), [(k,) for k in splits])
    s.sql(f"INSERT INTO TABLE {name} SELECT {COLUMNS[what]} FROM src_{what}")
    _shared[at] = s
    return s


# -- scans by key


def key_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "orders").scan("orders_k", key("o_orderkey") == 100)


def key_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "orders").scan("orders_k", key("o_orderkey").isin(1, 33, 100, 1000, 10**15))


def key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared(spark, sf_dir, "orders").scan("orders_k", key("o_orderkey").between(100, 400) & (key("o_totalprice") > 1000.0))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def key_only_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "orders").scan("orders_k", key("o_orderkey") < 50).select("o_orderkey")


def composite_key_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "events").scan("events_k", key("user_id") == 5)


def composite_key_tuple_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = ((key("user_id") == 3) & (key("event_id") < 500)) | ((key("user_id") == 8) & (key("event_id") >= 200))
    return shared(spark, sf_dir, "events").scan("events_k", either)


def dead_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "orders").scan("orders_k", (key("o_orderkey") < 8) & (key("o_orderkey") > 8)).select("o_orderkey")


def key_range_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "orders").scan("orders_k", ~((key("o_orderkey") > 20) | ~(key("o_orderkey") != 7))).select("o_orderkey", "o_custkey")


def sql_key_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL: the optimised plan's key conditions choose the regions that are read."""
    return shared(spark, sf_dir, "orders").sql(f"SELECT {COLUMNS['orders']} FROM orders_k WHERE o_orderkey = 100")


def sql_key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shared(spark, sf_dir, "orders")
    return s.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_k WHERE o_orderkey BETWEEN 100 AND 400 AND o_totalprice > 1000 GROUP BY o_orderstatus")


def provider_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shared(spark, sf_dir, "orders")
    register(s.spark)
    rows = s.spark.read.format("keystrata").option("table", "orders_k").load(s.storage.root)
    return rows.where("o_orderkey > 100").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def sql_composite_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "events").sql(f"SELECT {COLUMNS['events']} FROM events_k WHERE user_id IN (5, 11) AND event_id > 20")


def sql_keyed_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of one table, each with a range of its own."""
    s = shared(spark, sf_dir, "orders")
    return s.sql("SELECT a.o_orderkey AS k, count(*) AS n FROM orders_k a JOIN orders_k b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey < 60 AND b.o_orderkey >= 60 GROUP BY a.o_orderkey")


def keyed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table in plain SQL, joined with a temporary view."""
    s = shared(spark, sf_dir, "orders")
    return s.sql("SELECT c.c_mktsegment AS segment, count(*) AS n FROM orders_k o JOIN src_customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")


# -- statements and writes


def create_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir)
    s.sql(f"CREATE TABLE t {ORDERS};")
    s.sql(f"INSERT INTO TABLE t SELECT {COLUMNS['orders']} FROM src_orders")
    return s.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM t GROUP BY o_orderstatus")


SMALL = "(k int, s string, b boolean, t tinyint, h short, f float, d double, l bigint, PRIMARY KEY (k)) MAPPED BY (small_store, COLS=[s=c.s, b=c.b, t=c.t, h=c.h, f=c.f, d=c.d, l=c.l])"


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir)
    s.sql(f"CREATE TABLE t {SMALL}")
    s.sql("INSERT INTO TABLE t VALUES (1, 'it''s', true, 12, -300, 0.5, 2.25, 9000000000)")
    s.sql("INSERT INTO TABLE t VALUES (2, NULL, FALSE, NULL, 7, NULL, -1e3, NULL);")
    s.sql("INSERT INTO TABLE t VALUES (-3, '', NULL, 'a', NULL, 1, .5, 0)")
    return s.sql("SELECT * FROM t")


def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second insert replaces whole rows of existing keys."""
    s = fresh(spark, sf_dir)
    s.sql(f"CREATE TABLE t {ORDERS}")
    s.sql(f"INSERT INTO TABLE t SELECT {COLUMNS['orders']} FROM src_orders")
    s.sql("INSERT INTO TABLE t SELECT o_orderkey, NULL, 'X', -o_totalprice, o_orderpriority FROM src_orders WHERE o_orderstatus = 'F'")
    return s.table("t")


def _lines(s: KeyedSession, query: str) -> str:
    path = scratch(s.spark, "lines")
    s.spark.sql(query).write.text(path)
    return path


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir)
    s.sql(f"CREATE TABLE t {ORDERS}")
    path = _lines(s, "SELECT concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority) FROM src_orders")
    s.sql(f"LOAD PARALL DATA INPATH '{path}' INTO TABLE t FIELDS TERMINATED BY '\\\\|'")
    return s.table("t")


def load_cell_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a later load leaves empty keep the older cell; a value says which are empty."""
    s = fresh(spark, sf_dir)
    s.sql(f"CREATE TABLE t {ORDERS}")
    s.sql(f"INSERT INTO TABLE t SELECT {COLUMNS['orders']} FROM src_orders")
    path = _lines(s, "SELECT concat(o_orderkey, ',', if(o_orderstatus = 'O', '', '7'), ',Z,,') FROM src_orders")
    s.sql(f"LOAD DATA INPATH '{path}' INTO TABLE t")
    return s.table("t")


def load_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines, empty fields and blank lines; a row of NULLs is still a row. The second keys lie behind the first ones."""
    s = fresh(spark, sf_dir)
    s.sql(f"CREATE TABLE t {ORDERS}")
    path = _lines(s, "SELECT explode(array('', concat(o_orderkey, ''), concat(o_orderkey + shift, ',5,,'))) FROM src_orders CROSS JOIN (SELECT max(o_orderkey) + 1 AS shift FROM src_orders)")
    s.sql(f"LOAD DATA INPATH '{path}' INTO TABLE t")
    return s.table("t")


def load_presplit_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and key bounds of each region, from the files of a pre-split table."""
    s = fresh(spark, sf_dir)
    made = parse(f"CREATE TABLE t {ORDERS}")
    table = s.create(made, [(k,) for k in (10, 20, 40, 80, 160, 320)])
    path = _lines(s, "SELECT concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority) FROM src_orders")
    s.sql(f"LOAD DATA INPATH '{path}' INTO TABLE t")
    parts = [s.storage.read(table, [int(r)]).select(F.lit(int(r)).alias("region"), "o_orderkey") for r in s.storage.manifest(table)["regions"]]
    out = parts[0] if parts else s.table("t").select(F.lit(0).alias("region"), "o_orderkey")
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("region").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


def alter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir)
    s.sql("CREATE TABLE t (k int, a string, PRIMARY KEY (k)) MAPPED BY (alter_store, COLS=[a=f.a])")
    s.sql("INSERT INTO TABLE t SELECT n_nationkey, n_name FROM src_nation")
    s.sql("ALTER TABLE t ADD z bigint MAPPED BY (z = f.z)")
    s.sql("INSERT INTO TABLE t SELECT n_nationkey, n_name, n_nationkey * 10 FROM src_nation WHERE n_nationkey < 5")
    return s.table("t")


def alter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir)
    s.sql("CREATE TABLE t (k int, a string, z int, PRIMARY KEY (k)) MAPPED BY (alter_store, COLS=[a=f.a, z=f.z])")
    s.sql("INSERT INTO TABLE t SELECT n_nationkey, n_name, n_regionkey FROM src_nation")
    s.sql("ALTER TABLE t DROP a")
    return s.sql("SELECT * FROM t")


def drop_and_map_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropping a table keeps its data for another mapping."""
    s = fresh(spark, sf_dir)
    s.sql("CREATE TABLE t (k int, a string, PRIMARY KEY (k)) MAPPED BY (kept_store, COLS=[a=f.a])")
    s.sql("INSERT INTO TABLE t SELECT n_nationkey, n_name FROM src_nation")
    s.sql("DROP TABLE t;")
    s.sql("CREATE TABLE again (id int, label string, PRIMARY KEY (id)) MAPPED BY (kept_store, COLS=[label=f.a])")
    return s.sql("SELECT id, label FROM again WHERE id > 3")


def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir)
    s.sql("CREATE TABLE t (v double, k2 string, k1 int, w smallint, PRIMARY KEY (k1, k2)) MAPPED BY (d_store, COLS=[v=f.x, w=g.y])")
    return s.sql("DESCRIBE t")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir)
    for name in ("b", "a", "gone"):
        s.sql(f"CREATE TABLE {name} (k int, v int, PRIMARY KEY (k)) MAPPED BY (s_{name}, COLS=[v=f.v])")
    s.sql("DROP TABLE gone")
    return s.sql("SHOW TABLES")


def stringformat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells kept as text compare by their declared types."""
    s = fresh(spark, sf_dir)
    s.sql(f"CREATE TABLE t {ORDERS} IN STRINGFORMAT")
    s.sql(f"INSERT INTO TABLE t SELECT {COLUMNS['orders']} FROM src_orders")
    return s.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM t WHERE o_totalprice > 9000 AND o_custkey < 1000 AND 5 < o_custkey")


def two_tables_one_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logical tables on one physical one: each writes its own cells only."""
    s = fresh(spark, sf_dir)
    s.sql("CREATE TABLE ta (k int, a string, PRIMARY KEY (k)) MAPPED BY (one, COLS=[a=f.a])")
    s.create(parse("CREATE TABLE tb (id int, b int, a2 string, PRIMARY KEY (id)) MAPPED BY (one, COLS=[b=f.b, a2=f.a])"))
    s.sql("INSERT INTO TABLE ta SELECT n_nationkey, n_name FROM src_nation WHERE n_nationkey < 12")
    s.sql("INSERT INTO TABLE tb SELECT n_nationkey, n_regionkey, NULL FROM src_nation WHERE n_nationkey >= 8")
    s.sql("INSERT INTO TABLE ta SELECT n_nationkey, 'new' FROM src_nation WHERE n_nationkey >= 20")
    return s.sql("SELECT ta.k, ta.a, tb.b FROM ta JOIN tb ON ta.k = tb.id")


def cross_table_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT … SELECT with a join and a namespace."""
    s = fresh(spark, sf_dir)
    s.sql("CREATE TABLE t (region string, nation string, n bigint, PRIMARY KEY (region, nation)) MAPPED BY (ns.per_nation, COLS=[n=f.n])")
    s.sql("INSERT INTO TABLE t SELECT r_name, n_name, count(*) FROM src_customer JOIN src_nation ON c_nationkey = n_nationkey JOIN src_region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
    return s.sql("SELECT region, sum(n) AS customers FROM t GROUP BY region")


# -- layouts


def split_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of one region is cut into several; its rows stay."""
    s = fresh(spark, sf_dir)
    s.sql(f"CREATE TABLE t {ORDERS}")
    s.sql(f"INSERT INTO TABLE t SELECT {COLUMNS['orders']} FROM src_orders")
    s.split_regions("t", 1 << 14)
    return s.sql(f"SELECT {COLUMNS['orders']} FROM t")


def agg_key_prefix_no_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by the leading key column on the keyed layout itself: no exchange, one task a region."""
    s = shared(spark, sf_dir, "events")
    return s.aggregate("events_k", ["user_id"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        key_point_get, key_multi_get, key_range_scan, key_only_projection, composite_key_prefix, composite_key_tuple_or, dead_predicate,
        key_range_not, sql_key_point_get, sql_key_range_scan, provider_scan, sql_composite_prefix, sql_keyed_self_join, keyed_join, create_insert_select, insert_values, upsert_overwrite, load_csv, load_cell_merge, load_nulls,
        load_presplit_regions, alter_add, alter_drop, drop_and_map_again, describe_table, show_tables, stringformat_roundtrip,
        two_tables_one_store, cross_table_insert, split_regions, agg_key_prefix_no_shuffle,
    )
}
_O = COLUMNS["orders"]
ORACLES = {
    "key_point_get": f"SELECT {_O} FROM orders WHERE o_orderkey = 100",
    "key_multi_get": f"SELECT {_O} FROM orders WHERE o_orderkey IN (1, 33, 100, 1000)",
    "key_range_scan": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey BETWEEN 100 AND 400 AND o_totalprice > 1000 GROUP BY o_orderstatus",
    "key_only_projection": "SELECT o_orderkey FROM orders WHERE o_orderkey < 50",
    "composite_key_prefix": f"SELECT {COLUMNS['events']} FROM events WHERE user_id = 5",
    "composite_key_tuple_or": f"SELECT {COLUMNS['events']} FROM events WHERE (user_id = 3 AND event_id < 500) OR (user_id = 8 AND event_id >= 200)",
    "dead_predicate": "SELECT o_orderkey FROM orders WHERE o_orderkey < 8 AND o_orderkey > 8",
    "sql_key_point_get": f"SELECT {_O} FROM orders WHERE o_orderkey = 100",
    "sql_key_range_scan": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey BETWEEN 100 AND 400 AND o_totalprice > 1000 GROUP BY o_orderstatus",
    "provider_scan": "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey > 100 GROUP BY o_orderpriority",
    "sql_composite_prefix": f"SELECT {COLUMNS['events']} FROM events WHERE user_id IN (5, 11) AND event_id > 20",
    "sql_keyed_self_join": "SELECT a.o_orderkey AS k, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey < 60 AND b.o_orderkey >= 60 GROUP BY a.o_orderkey",
    "split_regions": f"SELECT {_O} FROM orders",
    "key_range_not": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 20 AND o_orderkey <> 7",
    "keyed_join": "SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "create_insert_select": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
    "insert_values": "SELECT CAST(k AS INT) AS k, s, b, CAST(t AS TINYINT) AS t, CAST(h AS SMALLINT) AS h, CAST(f AS FLOAT) AS f, CAST(d AS DOUBLE) AS d, CAST(l AS BIGINT) AS l FROM (VALUES (1, 'it''s', true, 12, -300, 0.5, 2.25, 9000000000), (2, NULL, false, NULL, 7, NULL, -1000, NULL), (-3, NULL, NULL, 97, NULL, 1, 0.5, 0)) v(k, s, b, t, h, f, d, l)",
    "upsert_overwrite": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders",
    "load_csv": f"SELECT {_O} FROM orders",
    "load_cell_merge": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey ELSE 7 END AS o_custkey, 'Z' AS o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "load_nulls": "SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders), 5, NULL, NULL, NULL FROM orders",
    "load_presplit_regions": "SELECT CAST(CASE WHEN o_orderkey < 10 THEN 0 WHEN o_orderkey < 20 THEN 1 WHEN o_orderkey < 40 THEN 2 WHEN o_orderkey < 80 THEN 3 WHEN o_orderkey < 160 THEN 4 WHEN o_orderkey < 320 THEN 5 ELSE 6 END AS INT) AS region, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1",
    "alter_add": "SELECT n_nationkey AS k, n_name AS a, CASE WHEN n_nationkey < 5 THEN CAST(n_nationkey AS BIGINT) * 10 END AS z FROM nation",
    "alter_drop": "SELECT n_nationkey AS k, n_regionkey AS z FROM nation",
    "drop_and_map_again": "SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey > 3",
    "describe_table": "SELECT * FROM (VALUES ('k1', 'int', 'KEY COLUMN', '0', NULL), ('k2', 'string', 'KEY COLUMN', '1', NULL), ('v', 'double', 'NON KEY COLUMN', 'f', 'x'), ('w', 'short', 'NON KEY COLUMN', 'g', 'y')) t(name, type, role, order_or_family, qualifier)",
    "show_tables": "SELECT * FROM (VALUES ('a'), ('b')) t(tableName)",
    "stringformat_roundtrip": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 9000 AND o_custkey < 1000 AND o_custkey > 5",
    "two_tables_one_store": "SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 20 THEN 'new' WHEN n_nationkey < 8 THEN n_name END AS a, CASE WHEN n_nationkey >= 8 THEN n_regionkey END AS b FROM nation",
    "cross_table_insert": "SELECT r_name AS region, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "agg_key_prefix_no_shuffle": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, min(event_id) AS first FROM events GROUP BY user_id",
}
