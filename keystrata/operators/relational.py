"""The inherited relational surface: one query an operator, as SQL over the tables in braces.

Each entry is the text for this engine, and the text for the other SQL engine where that differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.statements import modern

SAME = None
TEXTS: dict[str, tuple[str, str | None]] = {
    # scans, projections, predicates
    "scan_full": ("SELECT r_regionkey, r_name FROM {region}", SAME),
    "not_pushdown": ("SELECT o_orderkey, o_totalprice FROM {orders} WHERE NOT (o_orderkey > 500 OR NOT (o_totalprice >= 1000 AND NOT o_orderstatus = 'F'))", SAME),
    "in_list": ("SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_nationkey IN (1, 5, 7) AND c_mktsegment IN ('BUILDING', 'MACHINERY')", SAME),
    "in_expr": ("SELECT c_custkey FROM {customer} WHERE c_nationkey IN (c_custkey % 25, 3 + 1)", SAME),
    "not_in": ("SELECT n_nationkey, n_name FROM {nation} WHERE n_regionkey NOT IN (0, 2)", SAME),
    "between": ("SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN 10 AND 20", SAME),
    "not_between": ("SELECT p_partkey, p_size FROM {part} WHERE p_size NOT BETWEEN 5 AND 45", SAME),
    "like": ("SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE '%A%' AND p_name LIKE '%_ bo_t'", SAME),
    "not_like": ("SELECT p_partkey, p_brand FROM {part} WHERE p_brand NOT LIKE '%1'", SAME),
    "is_null": ("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer}) t WHERE k IS NULL", SAME),
    "is_not_null": ("SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM {customer}) t WHERE k IS NOT NULL", SAME),
    "mixed_and_or": ("SELECT o_orderkey FROM {orders} WHERE (o_orderstatus = 'O' AND o_totalprice > 5000) OR (o_orderkey < 100 AND (o_custkey = 7 OR o_totalprice < 20000))", SAME),
    "reversed_literal": ("SELECT o_orderkey FROM {orders} WHERE 100 > o_orderkey AND 1000 <= o_totalprice", SAME),
    "arith_on_key": ("SELECT o_orderkey FROM {orders} WHERE o_orderkey * 2 + 1 < 200 AND o_orderkey % 7 = 3", SAME),
    "alias_dup_col": ("SELECT n_name AS a, n_name AS b, t.n_regionkey AS `nation` FROM {nation} AS t", "SELECT n_name AS a, n_name AS b, t.n_regionkey AS nation FROM {nation} AS t"),
    # joins
    "join_inner": ("SELECT n.n_name, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey", SAME),
    "join_comma": ("SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey AND r.r_regionkey < 2", SAME),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000", SAME),
    "join_right": ("SELECT s.s_suppkey, n.n_name FROM {supplier} s RIGHT OUTER JOIN {nation} n ON s.s_nationkey = n.n_nationkey", SAME),
    "join_full": ("SELECT a.k AS ka, b.k AS kb FROM (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey + 8 AS k FROM {nation}) b ON a.k = b.k", SAME),
    "join_semi_theta": ("SELECT n_nationkey FROM {nation} n LEFT SEMI JOIN {region} r ON n.n_regionkey < r.r_regionkey", "SELECT n_nationkey FROM {nation} n WHERE EXISTS (SELECT 1 FROM {region} r WHERE n.n_regionkey < r.r_regionkey)"),
    "join_cross_filter": ("SELECT a.r_name AS a, b.r_name AS b FROM {region} a CROSS JOIN {region} b WHERE a.r_regionkey + b.r_regionkey = 4", SAME),
    "join_null_safe": ("SELECT a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey AS n FROM {nation}) a JOIN (SELECT nullif(r_regionkey, 1) AS k, r_regionkey AS n FROM {region}) b ON a.k <=> b.k", "SELECT a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey AS n FROM {nation}) a JOIN (SELECT nullif(r_regionkey, 1) AS k, r_regionkey AS n FROM {region}) b ON a.k IS NOT DISTINCT FROM b.k"),
    "join_three_way": ("SELECT c.c_custkey, n.n_name, r.r_name FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 5000", SAME),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", SAME),
    "join_subquery": ("SELECT t.n_name, t.c, o.total FROM (SELECT n_nationkey, n_name, count(*) AS c FROM {nation} JOIN {customer} ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name) t JOIN (SELECT c_nationkey, round(sum(o_totalprice), 2) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_nationkey) o ON t.n_nationkey = o.c_nationkey", SAME),
    "join_outer_no_on": ("SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM {region} a LEFT OUTER JOIN {nation} b WHERE a.r_regionkey = b.n_regionkey", "SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM {region} a LEFT OUTER JOIN {nation} b ON true WHERE a.r_regionkey = b.n_regionkey"),
    "join_distinct_limit": ("SELECT n.n_name FROM {nation} n JOIN (SELECT DISTINCT n_regionkey AS k FROM {nation} ORDER BY k LIMIT 2) t ON n.n_regionkey = t.k", SAME),
    "join_no_match": ("SELECT a.n_name FROM {nation} a JOIN {region} b ON a.n_nationkey = b.r_regionkey + 1000", SAME),
    "join_many_to_many": ("SELECT count(*) AS n FROM (SELECT n_regionkey AS k FROM {nation}) a JOIN (SELECT n_regionkey AS k FROM {nation}) b ON a.k = b.k", SAME),
    # aggregates
    "agg_global": ("SELECT count(*) AS n, count(1) AS m, sum(l_linenumber) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_discount), 6) AS a FROM {lineitem}", "SELECT count(*) AS n, count(1) AS m, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_discount), 6) AS a FROM {lineitem}"),
    "agg_group": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS q FROM {lineitem} GROUP BY l_returnflag, l_linestatus", SAME),
    "agg_group_expr": ("SELECT o_custkey % 10 AS g, (o_custkey % 10) + 1 AS h, count(*) AS n FROM {orders} GROUP BY o_custkey % 10", SAME),
    "agg_having": ("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY o_custkey HAVING count(*) > 3 AND max(o_totalprice) > 1000 ORDER BY s DESC", SAME),
    "agg_null_handling": ("SELECT g, count(v) AS n, sum(v) AS s, min(v) AS lo, max(v) AS hi, avg(v) AS a FROM (SELECT n_regionkey AS g, CASE WHEN n_regionkey < 2 THEN NULL ELSE nullif(n_nationkey, 10) END AS v FROM {nation}) t GROUP BY g", "SELECT g, count(v) AS n, CAST(sum(v) AS BIGINT) AS s, min(v) AS lo, max(v) AS hi, avg(v) AS a FROM (SELECT n_regionkey AS g, CASE WHEN n_regionkey < 2 THEN NULL ELSE nullif(n_nationkey, 10) END AS v FROM {nation}) t GROUP BY g"),
    "agg_signed": ("SELECT -max(o_orderkey) AS a, - - max(o_orderkey) AS b, - + 20 AS c, + + min(o_orderkey) AS d FROM {orders}", SAME),
    "count_distinct": ("SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderstatus) AS m FROM {orders}", SAME),
    "count_distinct_multi": ("SELECT count(DISTINCT l_returnflag, l_linestatus) AS n FROM {lineitem}", "SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM {lineitem}"),
    "approx_count_distinct": ("SELECT APPROXIMATE COUNT(DISTINCT o_custkey) AS a, APPROXIMATE(0.02) COUNT(DISTINCT o_custkey) AS b FROM {orders}", ""),
    "last_value": ("SELECT n_nationkey, last(n_name) AS name FROM {nation} GROUP BY n_nationkey", "SELECT n_nationkey, last(n_name) AS name FROM {nation} GROUP BY n_nationkey"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}", SAME),
    # order, limits, set operations
    "order_multi": ("SELECT o_orderstatus, o_orderpriority, o_orderkey FROM {orders} ORDER BY o_orderstatus DESC, o_orderpriority, o_totalprice", SAME),
    "sort_by": ("SELECT o_orderkey, o_totalprice FROM {orders} SORT BY o_totalprice DESC", "SELECT o_orderkey, o_totalprice FROM {orders}"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", SAME),
    "limit_ordered": ("SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey LIMIT 7", SAME),
    "distribute_by": ("SELECT c_nationkey, c_custkey FROM {customer} DISTRIBUTE BY c_nationkey SORT BY c_custkey", "SELECT c_nationkey, c_custkey FROM {customer}"),
    "cluster_by": ("SELECT c_nationkey, c_custkey FROM {customer} CLUSTER BY c_nationkey", "SELECT c_nationkey, c_custkey FROM {customer}"),
    "union_all": ("SELECT n_name AS name, n_nationkey AS k FROM {nation} UNION ALL SELECT r_name, r_regionkey FROM {region}", SAME),
    "union_distinct": ("SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}", SAME),
    "union_coerce": ("SELECT r_regionkey AS v FROM {region} UNION ALL SELECT r_name FROM {region}", "SELECT CAST(r_regionkey AS VARCHAR) AS v FROM {region} UNION ALL SELECT r_name FROM {region}"),
    "except": ("SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT r_regionkey FROM {region}", SAME),
    "intersect": ("SELECT n_nationkey AS k FROM {nation} INTERSECT SELECT r_regionkey FROM {region}", SAME),
    "cte": ("WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n", SAME),
    "from_subquery": ("SELECT t.s, count(*) AS n FROM (SELECT o_orderstatus AS s, o_totalprice AS p FROM {orders} WHERE o_orderkey > 10) t WHERE t.p > 2000 GROUP BY t.s", SAME),
    # expressions
    "fn_math": ("SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS b, round(sqrt(CAST(c_custkey AS STRING)), 6) AS c, round(acos(c_custkey % 2), 9) AS d FROM {customer}", "SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS b, round(sqrt(CAST(c_custkey AS DOUBLE)), 6) AS c, round(acos(c_custkey % 2), 9) AS d FROM {customer}"),
    "fn_bitwise": ("SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS b, n_nationkey ^ 5 AS c, ~n_nationkey AS d FROM {nation}", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS b, xor(n_nationkey, 5) AS c, ~n_nationkey AS d FROM {nation}"),
    "fn_string": ("SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, substr(n_name, 2, 3) AS s, substring(n_name, 3) AS t FROM {nation}", SAME),
    "fn_case": ("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS a, CASE WHEN n_nationkey > 12 THEN 1 WHEN n_nationkey > 6 THEN 2 END AS b, if(n_nationkey > 3, 'x', 'y') AS c FROM {nation}", SAME),
    "fn_cast": ("SELECT c_custkey, CAST(c_custkey > 10 AS STRING) AS b, CAST(c_custkey AS STRING) AS s, CAST('1970-01-02 03:04:05' AS TIMESTAMP) < CAST('1971-01-01 00:00:00' AS TIMESTAMP) AS t FROM {customer}", "SELECT c_custkey, CAST(c_custkey > 10 AS VARCHAR) AS b, CAST(c_custkey AS VARCHAR) AS s, CAST('1970-01-02 03:04:05' AS TIMESTAMP) < CAST('1971-01-01 00:00:00' AS TIMESTAMP) AS t FROM {customer}"),
    "fn_cast_timestamp": ("SELECT o_orderkey FROM {orders} WHERE o_orderdate >= '1995-01-01 00:00:00' AND o_orderdate < '1996-01-01 00:00:00'", SAME),
    "fn_cast_unreadable": ("SELECT o_orderkey FROM {orders} WHERE o_orderdate = 'no date'", "SELECT o_orderkey FROM {orders} WHERE false"),
    "fn_unary_sign": ("SELECT n_nationkey, -n_nationkey AS a, - - n_nationkey AS b, - + n_nationkey AS c, -9223372036854775808 AS d, CAST(.5 AS DOUBLE) AS e, CAST(-.18 AS DOUBLE) AS f FROM {nation}", SAME),
    "fn_arithmetic": ("SELECT p_partkey, p_size + 2147483647L AS a, p_size - 3 * 2 AS b, p_retailprice * 2 - 1 AS c FROM {part}", "SELECT p_partkey, p_size + 2147483647::BIGINT AS a, p_size - 3 * 2 AS b, p_retailprice * 2 - 1 AS c FROM {part}"),
    "array_index": ("SELECT vec_id, embedding[0] AS a, embedding[vec_id % 8] AS b, array(array(vec_id, 7), array(8, 9))[0][1] AS c FROM {embeddings}", "SELECT vec_id, embedding[1] AS a, embedding[vec_id % 8 + 1] AS b, 7::BIGINT AS c FROM {embeddings}"),
    "struct_map_access": ("SELECT event_id, s.k AS k, s.inner.t AS t, m['type'] AS m, a[0].x AS x FROM (SELECT event_id, named_struct('k', user_id, 'inner', named_struct('t', event_type)) AS s, map('type', event_type, 'other', 'z') AS m, array(named_struct('x', value)) AS a FROM {events}) t", "SELECT event_id, user_id AS k, event_type AS t, event_type AS m, value AS x FROM {events}"),
}

PLACE = re.compile(r"\{(\w+)\}")


def lenient(spark: SparkSession) -> SparkSession:
    """A session with case-sensitive names and casts that give NULL, as these queries expect."""
    session = spark.newSession()
    session.conf.set("spark.sql.caseSensitive", "true")
    session.conf.set("spark.sql.ansi.enabled", "false")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    session = lenient(spark)
    names = set(PLACE.findall(text))
    for name in names:
        session.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return session.sql(modern(PLACE.sub(r"\1", text)))


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, text)


QUERIES = {name: _query(text) for name, (text, _) in TEXTS.items()}
ORACLES = {name: PLACE.sub(r"\1", text if other is None else other) for name, (text, other) in TEXTS.items() if other != ""}
