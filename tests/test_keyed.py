"""Statements and writes end to end, errors, and the plans that pruning and layouts lead to."""

import io
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from keystrata.cli import Shell
from keystrata.plans.predicates import key
from keystrata.plans.statements import parse
from keystrata.session import PRUNE, KeyedSession
from keystrata.sources.provider import register


@pytest.fixture()
def s(spark, tmp_path):
    return KeyedSession(spark, f"file://{tmp_path}/root")


T = "CREATE TABLE t (a int, s string, v double, w string, PRIMARY KEY (a, s)) MAPPED BY (p, COLS=[v=f.v, w=g.w])"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_merge_and_views(s, tmp_path):
    s.sql(T)
    s.sql("INSERT INTO TABLE t VALUES (1, 'x', 1.5, 'one')")
    s.sql("INSERT INTO TABLE t SELECT 1, 'x', NULL, 'two' UNION ALL SELECT 2, '', 3, ''")
    assert rows(s.sql("SELECT * FROM t")) == [(1, "x", None, "two"), (2, "", 3.0, None)]
    path = tmp_path / "more.txt"
    path.write_text("1,x,7,\n\n3,y\n1,x,,last\n")
    s.sql(f"LOAD DATA LOCAL INPATH '{path}' INTO TABLE t")
    assert rows(s.table("t")) == [(1, "x", 7.0, "last"), (2, "", 3.0, None), (3, "y", None, None)]
    assert s.table("t").schema["v"].metadata == {"family": "f", "qualifier": "v"}


def test_same_key_twice_in_one_load(s, tmp_path):
    s.sql("CREATE TABLE t (c1 string, c2 string, c3 string, PRIMARY KEY (c1)) MAPPED BY (p, COLS=[c2=f.a, c3=g.b])")
    path = tmp_path / "x.txt"
    path.write_text("row4,4,8\nrow5,5,10\nrow6,6,12\nrow5,6,11")
    s.sql(f"LOAD PARALL DATA LOCAL INPATH '{path}' INTO TABLE t FIELDS TERMINATED BY ','")
    assert rows(s.table("t")) == [("row4", "4", "8"), ("row5", "6", "11"), ("row6", "6", "12")]


def test_errors(s, tmp_path):
    s.sql(T)
    with pytest.raises(ValueError, match="exists already"):
        s.sql(T)
    for text in ("DROP TABLE no", "DESCRIBE no"):
        with pytest.raises(LookupError):
            s.sql(text)
    with pytest.raises(NotImplementedError):
        s.sql("INSERT OVERWRITE TABLE t SELECT 1, 'a', 2, 'b'")
    with pytest.raises(ValueError, match="Unrecognized data type"):
        s.sql("CREATE TABLE q (k int, d date, PRIMARY KEY (k)) MAPPED BY (q, COLS=[d=f.d])")
    with pytest.raises(ValueError, match="column family"):
        s.sql("CREATE TABLE q (a int, s string, z int, PRIMARY KEY (a, s)) MAPPED BY (p, COLS=[z=other.z])")
    assert not s.catalog.exists("q")
    with pytest.raises(ValueError, match="key of"):
        s.sql("CREATE TABLE q (a string, z int, PRIMARY KEY (a)) MAPPED BY (p, COLS=[z=f.z])")
    with pytest.raises(ValueError, match="part of the key"):
        s.sql("ALTER TABLE t DROP a")
    with pytest.raises(ValueError, match="has a column"):
        s.sql("ALTER TABLE t ADD v int MAPPED BY (v = f.v)")
    with pytest.raises(ValueError, match="columns"):
        s.sql("INSERT INTO TABLE t VALUES (1, 'a')")
    with pytest.raises(Exception, match="NULL in key column"):
        s.sql("INSERT INTO TABLE t VALUES (1, NULL, 2, 'b')")
    path = tmp_path / "x.txt"
    for line, what in (("1,a,zz,b", "not a double"), ("1,a,1,b,c", "4 columns")):
        path.write_text(line)
        with pytest.raises(Exception, match=what):
            s.sql(f"LOAD DATA LOCAL INPATH '{path}' INTO TABLE t")
    assert s.table("t").count() == 0


def test_another_session_sees_the_tables(s, spark):
    s.sql(T)
    s.sql("INSERT INTO TABLE t VALUES (1, 'x', 1.5, 'one')")
    other = KeyedSession(spark, s.storage.root)
    assert other.sql("SHOW TABLES").collect()[0][0] == "t" and other.sql("SELECT w FROM t").collect()[0][0] == "one"
    s.storage.compact(s.catalog.get("t"))
    assert other.table("t").count() == 1


def test_regions_are_pruned_and_sorted(s):
    s.create(parse("CREATE TABLE r (k int, v int, PRIMARY KEY (k)) MAPPED BY (rp, COLS=[v=f.v])"), [(i,) for i in range(1, 260, 2)])
    s.insert("r", s.spark.range(260).selectExpr("cast(id as int) k", "cast(id * 2 as int) v"))
    assert len(s.storage.manifest(s.catalog.get("r"))["regions"]) == 131
    assert s.regions("r", key("k") == 7) == [4] and s.regions("r", (key("k") < 3) | (key("k") > 257)) == [0, 1, 129, 130]
    found = s.scan("r", key("k").between(10, 13))
    assert len(found.inputFiles()) == len(s.regions("r", key("k").between(10, 13))) == 3
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key_0), GreaterThanOrEqual(key_0,10), LessThanOrEqual(key_0,13)]" in plan
    assert rows(found) == [(k, 2 * k) for k in range(10, 14)]
    only = found.select("k")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key_0:int>" in only
    s.spark.conf.set(PRUNE, "false")
    assert rows(s.scan("r", key("k").between(10, 13))) == [(k, 2 * k) for k in range(10, 14)]
    assert len(s.scan("r", key("k") == 7).inputFiles()) == 131
    s.spark.conf.set(PRUNE, "true")
    before = dict(s.storage.manifest(s.catalog.get("r"))["regions"])
    s.sql("INSERT INTO TABLE r VALUES (8, -1)")
    after = s.storage.manifest(s.catalog.get("r"))["regions"]
    assert [r for r in after if after[r] != before[r]] == ["4"]  # only the touched region is rewritten
    assert s.table("r").count() == 260


def test_no_exchange_when_grouping_by_the_leading_key(spark, sf_dir):
    from keystrata.operators.keyed import agg_key_prefix_no_shuffle

    df = agg_key_prefix_no_shuffle(spark, sf_dir)
    df.collect()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_udf_same_with_pruning_on_and_off(s):
    from pyspark.sql import functions as F
    from pyspark.sql import types as ST

    s.create(parse("CREATE TABLE u (k int, v int, PRIMARY KEY (k)) MAPPED BY (up, COLS=[v=f.v])"), [(50,)])
    s.insert("u", s.spark.range(100).selectExpr("cast(id as int)", "cast(id % 7 as int)"))
    s.spark.udf.register("plus", F.pandas_udf(lambda v: v + 1, ST.LongType()))
    out = []
    for prune in ("true", "false"):
        s.spark.conf.set(PRUNE, prune)
        out.append(rows(s.scan("u", key("k") > 60).where("plus(v) > 3").selectExpr("plus(k) AS p")))
    assert out[0] == out[1] and out[0]
    s.spark.conf.set(PRUNE, "true")


def test_stream_into_a_table(s, tmp_path):
    from keystrata.streaming.sink import upsert_stream

    s.sql("CREATE TABLE st (k int, v string, PRIMARY KEY (k)) MAPPED BY (sp, COLS=[v=f.v])")
    for i, pairs in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]]):
        s.spark.createDataFrame(pairs, "k int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = s.spark.readStream.schema("k int, v string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    upsert_stream(s, stream, "st", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    assert {r[0] for r in s.table("st").collect()} == {1, 2, 3}


def test_shell(s):
    out = io.StringIO()
    shell = Shell(s, out)
    for line in ("CREATE TABLE q (k int, v int, PRIMARY KEY (k))", "MAPPED BY (qp, COLS=[v=f.v]);", "INSERT INTO TABLE q VALUES (1, 2);", "SELECT *", "FROM q;", "! ls", "", "HELP LOAD", "SELECT * FROM nothing_here;"):
        assert not shell.onecmd(line)
    assert shell.onecmd("quit;") and "DESCRIBE" in shell.completenames("des")
    text = out.getvalue()
    assert "OK" in text and "|1  |2  |" in text and "Time taken" in text and "LOAD [PARALL] DATA" in text and "Error:" in text


def test_a_source_that_changes_between_evaluations_loses_no_row(s):
    import random

    from pyspark.sql import functions as F
    from pyspark.sql import types as ST

    s.create(parse("CREATE TABLE nd (k int, v int, PRIMARY KEY (k)) MAPPED BY (ndp, COLS=[v=f.v])"), [(i,) for i in range(10, 200, 10)])
    s.insert("nd", s.spark.range(200).selectExpr("cast(id as int)", "cast(id as int)"))
    somewhere = F.udf(lambda: random.SystemRandom().randrange(200), ST.IntegerType()).asNondeterministic()
    for _ in range(4):
        s.insert("nd", s.spark.range(1).select(somewhere(), F.lit(-1)))
        assert s.table("nd").count() == 200
    assert not [n for n in s.storage.files.names(s.storage.place(s.catalog.get("nd"))) if n.startswith("staging-")]


@pytest.fixture()
def regions(s):
    s.create(parse("CREATE TABLE r (k int, v int, PRIMARY KEY (k)) MAPPED BY (rp, COLS=[v=f.v])"), [(i,) for i in range(10, 200, 10)])
    s.insert("r", s.spark.range(200).selectExpr("cast(id as int) k", "cast(id * 2 as int) v"))
    return s


SQL_RANGES = [
    ("k = 7", key("k") == 7), ("7 >= k", key("k") <= 7), ("k IN (3, 77, 500)", key("k").isin(3, 77, 500)), ("k BETWEEN 18 AND 22", key("k").between(18, 22)),
    ("NOT (k < 150 OR k = 170)", (key("k") >= 150) & (key("k") != 170)), ("k < 5 OR (k > 190 AND v > 3)", (key("k") < 5) | (key("k") > 190)), ("k < 5 AND k > 7", key("k").isin()),
    (f"k IN ({', '.join(map(str, range(40, 52)))})", key("k").between(40, 51)), ("v = 14", None), ("k % 100 = 7", None),
]


@pytest.mark.parametrize("text, same", SQL_RANGES)
def test_sql_reads_the_regions_that_the_api_reads(regions, text, same):
    s = regions
    found = s.sql(f"SELECT * FROM r WHERE {text}")
    files = len(found.inputFiles())
    if same is None:
        assert files == 20
    else:
        assert files == len(s.regions("r", same))
    got = rows(found)
    s.spark.conf.set(PRUNE, "false")
    assert got == rows(s.sql(f"SELECT * FROM r WHERE {text}")) and (text == "k < 5 AND k > 7" or got)
    s.spark.conf.set(PRUNE, "true")
    assert s.sql("SELECT count(*) FROM r").first()[0] == 200  # the view is whole again


def test_sql_pruning_of_several_scans(regions):
    s = regions
    both = s.sql("SELECT a.k, b.v FROM r a JOIN r b ON a.v = b.v WHERE a.k = 7 AND b.k < 40")
    assert len(both.inputFiles()) <= 5 and rows(both) == [(7, 14)]
    assert rows(s.sql("SELECT count(*) FROM r WHERE k = 3 OR v > (SELECT max(v) FROM r WHERE k < 190)")) == [(11,)]
    union = s.sql("SELECT k FROM r WHERE k = 5 UNION ALL SELECT k FROM r WHERE k = 105")
    assert len(union.inputFiles()) == 2 and rows(union) == [(105,), (5,)]
    assert s.sql("WITH x AS (SELECT * FROM r WHERE k < 20) SELECT sum(k) FROM x").first()[0] == 190
    s.spark.sql("SELECT * FROM r").cache()
    assert s.sql("SELECT v FROM r WHERE k = 150").first()[0] == 300
    s.spark.catalog.clearCache()


def test_sql_pruning_of_composite_and_text_keys(s):
    s.create(parse("CREATE TABLE c (a string, b bigint, v double, PRIMARY KEY (a, b)) MAPPED BY (cp, COLS=[v=f.v])"), [("b",), ("b", 5), ("c",), ("d",)])
    s.insert("c", s.spark.sql("SELECT explode(array('a', 'b', 'bz', 'c', 'd')), id, id / 2 FROM range(10)"))
    for text, files in (("a = 'b' AND b < 5", 1), ("a = 'b'", 2), ("a LIKE 'b%'", 2), ("a > 'c'", 2), ("a IN ('a', 'd') AND b = 3", 2), ("b = 3", 5)):
        found = s.sql(f"SELECT * FROM c WHERE {text}")
        assert len({f.split("region=")[1].split("/")[0] for f in found.inputFiles()}) == files, text
        assert found.count() == s.spark.sql(f"SELECT * FROM c WHERE {text}").count()


def test_statements_see_what_other_sessions_did(regions, spark):
    s = regions
    other = KeyedSession(spark, s.storage.root)
    assert s.sql("SELECT count(*) FROM r").first()[0] == 200
    other.sql("INSERT INTO TABLE r VALUES (1000, 1)")
    assert s.sql("SELECT count(*) FROM r").first()[0] == 201
    other.storage.compact(other.catalog.get("r"), keep_seconds=0)
    assert s.sql("SELECT count(*) FROM r WHERE k > 100").first()[0] == 100
    other.sql("CREATE TABLE late (k int, v int, PRIMARY KEY (k)) MAPPED BY (lp, COLS=[v=f.v])")
    assert s.sql("SELECT * FROM late").count() == 0
    other.sql("DROP TABLE late")
    with pytest.raises(Exception, match="late"):
        s.sql("SELECT * FROM late")
    s.spark.conf.set("keystrata.metadata.seconds", "3600")
    s.sql("SELECT 1 FROM r")
    other.sql("INSERT INTO TABLE r VALUES (1001, 1)")
    assert s.sql("SELECT count(*) FROM r").first()[0] == 201
    s.spark.conf.unset("keystrata.metadata.seconds")
    assert s.sql("SELECT count(*) FROM r").first()[0] == 202


def test_compact_keeps_what_was_replaced_a_moment_ago(regions):
    s = regions
    old = s.table("r")
    s.sql("INSERT INTO TABLE r VALUES (3, -1)")
    s.storage.compact(s.catalog.get("r"))
    assert old.count() == 200
    s.storage.compact(s.catalog.get("r"), keep_seconds=0)
    assert s.table("r").count() == 200
    folder = f"{s.storage.place(s.catalog.get('r'))}/_manifests"
    assert len(s.storage.files.names(folder)) == 1


def test_grouping_by_region_needs_no_exchange(s):
    from pyspark.sql import functions as F

    s.create(parse("CREATE TABLE g (a int, b int, v int, PRIMARY KEY (a, b)) MAPPED BY (gp, COLS=[v=f.v])"), [(3,), (6,)])
    assert s.aggregate("g", ["a"], F.count("*").alias("n")).collect() == []
    s.insert("g", s.spark.range(100).selectExpr("cast(id % 9 as int)", "cast(id as int)", "cast(id as int)"))
    found = s.aggregate("g", ["a"], F.sum("v").alias("total"))
    assert rows(found) == [(a, sum(range(a, 100, 9))) for a in range(9)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="begin with"):
        s.aggregate("g", ["b"], F.count("*"))
    s.create(parse("CREATE TABLE g2 (a int, b int, v int, PRIMARY KEY (a, b)) MAPPED BY (gp2, COLS=[v=f.v])"), [(3, 1)])
    with pytest.raises(ValueError, match="a, b"):
        s.aggregate("g2", ["a"], F.count("*"))


@pytest.mark.parametrize("kind", ["int", "string"])
def test_large_regions_are_split(s, kind):
    s.create(parse(f"CREATE TABLE big (k {kind}, v int, PRIMARY KEY (k)) MAPPED BY (bp_{kind}, COLS=[v=f.v])"), [(cast(500),) for cast in [{"int": int, "string": lambda x: f"{x:05d}"}[kind]]])
    key_of = "cast(id as int)" if kind == "int" else "lpad(id, 5, '0')"
    s.insert("big", s.spark.range(3000).selectExpr(key_of, "cast(hash(id) as int)"))
    table = s.catalog.get("big")
    before = s.storage.manifest(table)
    assert s.split_regions("big", 1 << 30) == []
    added = s.split_regions("big", 6000)
    after = s.storage.manifest(table)
    assert added and len(after["splits"]) == 1 + len(added) and after["splits"] == sorted(after["splits"])
    assert before["regions"]["0"] in after["regions"].values() or len(after["regions"]) > 3
    splits = [x[0] for x in after["splits"]]
    for r, _ in after["regions"].items():
        low, high = s.storage.read(table, [int(r)]).selectExpr("min(k)", "max(k)").first()
        assert (int(r) == 0 or splits[int(r) - 1] <= low) and (int(r) == len(splits) or high < splits[int(r)])
    assert s.sql("SELECT count(*), count(DISTINCT k) FROM big").first()[:] == (3000, 3000)
    s.insert("big", s.spark.range(1).selectExpr("cast(7 as int)" if kind == "int" else "'00007'", "-5"))
    assert s.sql("SELECT v FROM big WHERE k = " + ("7" if kind == "int" else "'00007'")).first()[0] == -5


def jobs_of(spark, action):
    """How many Spark jobs an action takes, and its result."""
    name = f"counted-{id(action)}"
    spark.sparkContext.setJobGroup(name, "")
    try:
        found = action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), found
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_cost_of_splitting_does_not_grow_with_the_cuts(s, kind, monkeypatch):
    key_of = "id" if kind == "bigint" else "lpad(id, 5, '0')"
    s.create(parse(f"CREATE TABLE few (k {kind}, v int, PRIMARY KEY (k)) MAPPED BY (few_p, COLS=[v=f.v])"))
    s.create(parse(f"CREATE TABLE many (k {kind}, v int, PRIMARY KEY (k)) MAPPED BY (many_p, COLS=[v=f.v])"))
    compared, region = [], s.storage.region
    monkeypatch.setattr(s.storage, "region", lambda splits, *a: compared.append(len(splits)) or region(splits, *a))
    took = {}
    for name, parts in (("few", 3), ("many", 80)):
        s.insert(name, s.spark.range(4000).selectExpr(key_of, "cast(hash(id) as int)"))
        table = s.catalog.get(name)
        size = sum(n for place in s.storage.manifest(table)["regions"].values() for _, n in s.storage.files.sizes(place))
        compared.clear()
        took[name], added = jobs_of(s.spark, lambda: s.storage.split(table, -(-size // parts)))
        assert len(added) == parts - 1
        assert compared == [0]  # rows are compared with the split keys from before, not with the new ones
        counts = [s.storage.read(table, [int(r)]).count() for r in sorted(s.storage.manifest(table)["regions"], key=int)[:9]]
        assert max(counts) - min(counts) <= 1
        assert rows(s.table(name).selectExpr("cast(k as bigint)")) == [(i,) for i in sorted(range(4000), key=lambda i: repr((i,)))]
    assert took["many"] <= took["few"] + 2


def test_splitting_with_repeats_and_nan_in_the_leading_column(s):
    """Cuts lie between values of the leading column; several regions are cut at once, small ones stay."""
    s.create(parse("CREATE TABLE d (x double, n int, v string, PRIMARY KEY (x, n)) MAPPED BY (dp, COLS=[v=f.v])"), [(-50.0,), (5.0, 700), (90.0,)])
    value = "CASE WHEN id % 10 = 0 THEN double('NaN') WHEN id % 3 = 0 THEN double(7) WHEN id % 7 = 0 THEN double(-0.0) ELSE double(id % 40) - 10 END"
    s.insert("d", s.spark.range(6000).selectExpr(value, "cast(id as int)", "sha2(string(id), 256)"))
    s.insert("d", s.spark.range(5).selectExpr("double(-60 - id)", "cast(id as int)", "'small'"))
    before, table = rows(s.table("d").selectExpr("string(x)", "n", "v")), s.catalog.get("d")
    small = s.storage.manifest(table)["regions"]["0"]
    added = s.split_regions("d", 20000)
    held = s.storage.manifest(table)
    assert len(added) > 5 and len({v for v, in added}) == len(added) and held["regions"]["0"] == small
    assert rows(s.table("d").selectExpr("string(x)", "n", "v")) == before
    keys, kinds = [F.col("x"), F.col("n")], held["keys"]
    for r in held["regions"]:  # each row lies in the region that its key belongs to
        wrong = s.storage.read(table, [int(r)]).where(s.storage.region(held["splits"], keys, kinds) != int(r))
        assert wrong.count() == 0, r
    s.insert("d", s.spark.range(6000).selectExpr(value, "cast(id as int)", "'new'"))
    assert s.sql("SELECT count(*), count_if(v = 'new') FROM d").first()[:] == (6005, 6000)


def test_many_split_keys_are_searched_by_halves(s):
    splits = [[i * 3, *([i] if i % 4 == 0 else [])] for i in range(1, 1500)]
    keys = [F.col("a"), F.col("b")]
    region = s.storage.region(splits, keys, ["int", "int"])
    found = s.spark.range(0, 4600).selectExpr("cast(id as int) a", "cast(id % 1500 as int) b").select("a", "b", region.alias("r")).collect()
    for a, b, r in found:
        assert r == sum(tuple(x) <= (a, b) for x in splits), (a, b)
    for n in (65, 1500):
        text = s.storage.region([[i] for i in range(n)], keys[:1], ["int"])._jc.toString()
        assert "filter" not in text, text[:300]  # no scan of split keys


def test_listing_of_many_regions_takes_few_tasks(s):
    n = 700
    s.create(parse("CREATE TABLE m (k int, v int, PRIMARY KEY (k)) MAPPED BY (mp, COLS=[v=f.v])"), [(i,) for i in range(1, n)])
    s.insert("m", s.spark.range(n).selectExpr("cast(id as int)", "1"))
    tracker = s.spark.sparkContext.statusTracker()
    s.spark.sparkContext.setJobGroup("listing", "")
    try:
        s.refresh("m")
        stages = [i for j in tracker.getJobIdsForGroup("listing") for i in tracker.getJobInfo(j).stageIds]
        assert max(tracker.getStageInfo(i).numTasks for i in stages) <= 256
    finally:
        s.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert s.table("m").count() == n


def test_names_in_a_folder(s, tmp_path):
    (tmp_path / "x").mkdir()
    assert s.storage.files.names(f"file://{tmp_path}/x") == s.storage.files.names(f"file://{tmp_path}/none") == []
    for n in ("a,b", "c d", "e", "{f}", "é"):
        (tmp_path / "x" / n).touch()
    assert s.storage.files.names(f"file://{tmp_path}/x") == sorted(["a,b", "c d", "e", "{f}", "é"])


def test_provider(s, spark):
    root = s.storage.root
    s.create(parse(T), [(10,), (20,)])
    s.sql("INSERT INTO TABLE t SELECT CAST(id AS int), concat('s', id), id / 2, IF(id % 3 = 0, NULL, 'w') FROM range(30)")
    register(s.spark)
    read = lambda: s.spark.read.format("keystrata").option("table", "t").load(root)
    assert read().dtypes == s.table("t").dtypes
    assert rows(read()) == rows(s.table("t"))
    for where in ("a >= 20", "a = 5", "a IN (1, 25, 99)", "a < 3 AND v > 0.4", "NOT (a > 4)", "a = 400", "w IS NULL", "s LIKE 's1%'"):
        assert rows(read().where(where)) == rows(s.table("t").where(where)), where
    assert read().where("a >= 20").rdd.getNumPartitions() == 1 and read().rdd.getNumPartitions() == 3
    s.sql("INSERT INTO TABLE t VALUES (99, 'z', 1.0, 'new')")
    assert read().count() == 31  # another query sees what has been written since
    with pytest.raises(Exception, match="gone"):
        s.spark.read.format("keystrata").option("table", "gone").load(root).count()


def test_shell_keeps_its_lines(tmp_path):
    path = str(tmp_path / "history")
    code = f"import readline; from keystrata.cli import remember; assert remember({path!r}); readline.add_history('SHOW TABLES;')"
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for n in (1, 2):
        subprocess.run([sys.executable, "-c", code], check=True, cwd=home)
        assert open(path).read().count("SHOW TABLES;") == n
