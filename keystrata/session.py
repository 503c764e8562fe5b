"""The session: SQL text and a small API over keyed tables."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import from_text, spark_type
from .plans import pushdown
from .plans import statements as st
from .plans.predicates import Predicate, push_not
from .plans.ranges import key_ranges, regions_of
from .sources.catalog import Catalog, Table
from .sources.ingest import read_text
from .sources.storage import Storage

#: Settings of this engine: whether key ranges prune regions; for how many seconds a statement may go on with what
#: an earlier one has read of a table's metadata.
PRUNE, FRESH = "keystrata.prune", "keystrata.metadata.seconds"
#: Statements that only read, by their first word.
READING = re.compile(r"[\s(]*(SELECT|WITH|FROM|VALUES|TABLE)\b(?!.*\bINSERT\s+(INTO|OVERWRITE)\b)", re.IGNORECASE | re.DOTALL)


class KeyedSession:
    """Wraps a session of its own (same cluster and data) with case-sensitive names and lenient casts.
    root: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.caseSensitive", "true")
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        # folders of many regions are listed in a few tasks, not in one each
        self.spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(max(256, 4 * self.spark.sparkContext.defaultParallelism)))
        self.catalog, self.storage = Catalog(self.spark, root), Storage(self.spark, root)
        self._seen: dict[str, tuple] = {}  # what each view was made from
        self._read_at = 0.0
        for name in self.catalog.names():
            self.refresh(name)

    # -- SQL

    def sql(self, text: str) -> DataFrame:
        match st.parse(text):
            case st.CreateTable() as made:
                self.create(made)
            case st.DropTable(name):
                self.catalog.drop(name)
                self.spark.catalog.dropTempView(name)
                self._seen.pop(name, None)
            case st.AlterAdd(name, column):
                table = self.catalog.get(name)
                if column.family not in self.storage.manifest(table)["families"]:
                    raise ValueError(f"{table.physical} has no column family {column.family}")
                self.catalog.add_column(name, column)
                self.refresh(name)
            case st.AlterDrop(name, column):
                self.catalog.drop_column(name, column)
                self.refresh(name)
            case st.ShowTables():
                return self.spark.createDataFrame([(n,) for n in self.catalog.names()], "`tableName` string")
            case st.Describe(name):
                return self.describe(name)
            case st.InsertValues(name, values):
                self.insert_values(name, values)
            case st.InsertSelect(_, _, True):
                raise NotImplementedError("INSERT OVERWRITE is not supported")
            case st.InsertSelect(name, query):
                if not self.catalog.exists(name):
                    return self.spark.sql(st.modern(text))
                self.insert(name, self.query(st.modern(query)))
            case st.Load(name, path, local, _, separator):
                self.load(name, path, separator, local)
            case _:
                return self.query(st.modern(text.strip().removesuffix(";")))
        return self.spark.createDataFrame([], "result string")

    def query(self, text: str) -> DataFrame:
        """Any other statement, by Spark. It sees the newest state of the keyed tables; of a query, the key
        conditions in the optimised plan choose the regions that each table's scans read."""
        named = self.reread(text)
        rows = self.spark.sql(text)
        if not named or not READING.match(text) or self.spark.conf.get(PRUNE, "true") != "true":
            return rows
        found = pushdown.scans(rows._jdf.queryExecution().optimizedPlan())
        narrowed = [name for name in named if found is not None and self._narrow(name, found)]
        if narrowed:
            try:
                rows = self.spark.sql(text)
            finally:
                for name in narrowed:
                    self.refresh(name)
        return rows

    def _narrow(self, name: str, found: list[tuple[str, Predicate]]) -> bool:
        """Make the view show only the regions that some scan of the table may find rows in, if these are fewer."""
        table, manifest, _ = self._seen[name]
        place = self.storage.files.plain(self.storage.place(table))
        keys = [(f"key_{i}", kind) for i, kind in enumerate(manifest["keys"])]
        splits = [tuple(x) for x in manifest["splits"]]
        wanted: set[int] = set()
        for path, predicate in found:
            if path.startswith(f"{place}/"):
                wanted.update(regions_of(key_ranges(push_not(predicate), keys), splits))
        held = {int(r) for r in manifest["regions"]}
        if held <= wanted:
            return False
        self.storage.read(table, sorted(held & wanted), manifest).createOrReplaceTempView(name)
        return True

    def reread(self, text: str | None = None) -> list[str]:
        """Renew the views of keyed tables that other sessions have changed; names of those that a text mentions."""
        if time.monotonic() - self._read_at >= float(self.spark.conf.get(FRESH, "0")):
            self._read_at = time.monotonic()
            there = self.catalog.names()
            for name in set(self._seen) - set(there):
                self.spark.catalog.dropTempView(name)
                del self._seen[name]
            for name in there:
                if text is None or name not in self._seen or re.search(rf"\b{re.escape(name)}\b", text):
                    self.refresh(name, unless_same=True)
        return [n for n in self._seen if text is None or re.search(rf"\b{re.escape(n)}\b", text)]

    # -- tables

    def create(self, made: st.CreateTable, splits: Sequence[tuple] = (), families: Sequence[str] = ()) -> Table:
        """splits: ascending split keys (or their leading columns) of a new physical table."""
        table = self.catalog.create(made)
        try:
            self.storage.create(table, splits, families)
        except Exception:
            self.catalog.drop(table.name)
            raise
        self.refresh(table.name)
        return table

    def refresh(self, name: str, unless_same: bool = False) -> None:
        table = self.catalog.get(name)
        manifest = self.storage.manifest(table)
        state = (table, manifest, manifest["version"])
        if unless_same and name in self._seen and (self._seen[name][0], self._seen[name][2]) == (table, manifest["version"]):
            return
        self.storage.read(table, None, manifest).createOrReplaceTempView(name)
        self._seen[name] = state

    def table(self, name: str) -> DataFrame:
        return self.storage.read(self.catalog.get(name)) if self.catalog.exists(name) else self.spark.table(name)

    def describe(self, name: str) -> DataFrame:
        table = self.catalog.get(name)
        rows = [(k, table.column(k).kind, "KEY COLUMN", str(i), None) for i, k in enumerate(table.keys)]
        rows += [(c.name, c.kind, "NON KEY COLUMN", c.family, c.qualifier) for c in table.cells]
        return self.spark.createDataFrame(rows, "name string, type string, role string, order_or_family string, qualifier string")

    def scan(self, name: str, predicate: Predicate | None = None) -> DataFrame:
        """Rows that satisfy a predicate. Its key comparisons choose the regions that are read; the
        whole predicate then filters, and reaches the Parquet reader."""
        table = self.catalog.get(name)
        if predicate is None:
            return self.storage.read(table)
        predicate = push_not(predicate)
        found = self.regions(name, predicate) if self.spark.conf.get(PRUNE, "true") == "true" else None
        if found == []:
            return self.storage.read(table, []).where(F.lit(False))
        return self.storage.read(table, found).where(predicate.column())

    def regions(self, name: str, predicate: Predicate) -> list[int]:
        """Numbers of the regions that a predicate may find rows in."""
        table = self.catalog.get(name)
        return regions_of(key_ranges(push_not(predicate), table.key_types), self.storage.splits(table))

    def aggregate(self, name: str, by: Sequence[str], *columns: Column) -> DataFrame:
        """Groups by columns that begin with the key, without a shuffle: a region holds the rows of whole groups
        and is one task. by must begin with as many key columns as the longest split key has."""
        table = self.catalog.get(name)
        manifest = self.storage.manifest(table)
        lead = max([1, *map(len, manifest["splits"])])
        if list(by[:lead]) != list(table.keys[:lead]):
            raise ValueError(f"groups of {name} begin with {', '.join(table.keys[:lead])}, else a region's end may cut them")
        regions = sorted(map(int, manifest["regions"])) or [None]
        parts = [self.storage.read(table, [] if r is None else [r], manifest).coalesce(1).groupBy(*by).agg(*columns) for r in regions]
        return reduce(DataFrame.union, parts)

    def split_regions(self, name: str, max_bytes: int = 4 << 30) -> list[tuple]:
        """Cut regions that have grown over max_bytes; the new split keys."""
        table = self.catalog.get(name)
        found = self.storage.split(table, max_bytes)
        self.refresh_all(table)
        return found

    # -- rows

    def insert(self, name: str, rows: DataFrame) -> None:
        """By position; existing keys are overwritten, NULL cells included."""
        table = self.catalog.get(name)
        if len(rows.columns) != len(table.columns):
            raise ValueError(f"{name} has {len(table.columns)} columns, {len(rows.columns)} are given")
        self.storage.write(table, rows.toDF(*(c.name for c in table.columns)))
        self.refresh_all(table)

    def insert_values(self, name: str, values: Sequence[str | None]) -> None:
        table = self.catalog.get(name)
        if len(values) != len(table.columns):
            raise ValueError(f"{name} has {len(table.columns)} columns, {len(values)} are given")
        typed = [from_text(F.lit(v).cast("string"), c.kind, f"{name}.{c.name}") if v is not None else F.lit(None).cast(spark_type(c.kind)) for v, c in zip(values, table.columns)]
        self.insert(name, self.spark.range(1).select(*(t.alias(c.name) for t, c in zip(typed, table.columns))))

    def load(self, name: str, path: str, separator: str = ",", local: bool = False) -> None:
        """Cells that are empty in the text keep what the table has."""
        table = self.catalog.get(name)
        self.storage.write(table, read_text(self.spark, table, path, separator, local), merge_cells=True)
        self.refresh_all(table)

    def refresh_all(self, written: Table) -> None:
        """Views of all logical tables on the physical table that was written."""
        for name in self.catalog.names():
            other = self.catalog.get(name)
            if (other.namespace, other.physical) == (written.namespace, written.physical):
                self.refresh(name)
