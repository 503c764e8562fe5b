"""A data source over keyed tables, for sessions that know nothing of this engine's catalog.

    register(spark)
    spark.read.format("keystrata").option("table", "t").load(root)

Filters on the key that Spark pushes down choose the regions, as in KeyedSession; each region's files are one task
and are read in Arrow batches. Spark applies all filters again, and prunes no columns of a Python source, so
KeyedSession's own scans are the faster way. Metadata are read when a query is planned. root must be in a file system
that pyarrow reaches, and cells stored in another type than the table's (string format) are refused.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from ..functions.types import spark_type
from ..plans.predicates import Predicate, key, push_not
from ..plans.ranges import key_ranges, regions_of

#: Spark's setting by which Python data sources are asked for filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make format("keystrata") known to a session; executors get the code with the tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__.split(".")[0]])
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(KeyedSource)


def newest(fs: pa.fs.FileSystem, folder: str, prefix: str, dots: int) -> dict:
    """The last of a folder's versioned JSON files."""
    names = sorted(f.base_name for f in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith(prefix) and f.base_name.endswith(".json") and f.base_name.count(".") == dots)
    if not names:
        raise LookupError(f"nothing named {prefix or 'a version'} in {folder}")
    with fs.open_input_stream(f"{folder}/{names[-1]}") as stream:
        return json.loads(stream.read())


def predicate_of(f: ds.Filter) -> Predicate | None:
    """A pushed filter on one whole column as a predicate; None of any other."""
    if isinstance(f, ds.Not):
        part = predicate_of(f.child)
        return None if part is None else ~part
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = key(f.attribute[0])
    match f:
        case ds.EqualTo():
            return name == f.value
        case ds.GreaterThan():
            return name > f.value
        case ds.GreaterThanOrEqual():
            return name >= f.value
        case ds.LessThan():
            return name < f.value
        case ds.LessThanOrEqual():
            return name <= f.value
        case ds.In():
            return name.isin(*f.value)
    return None


class Region(ds.InputPartition):
    def __init__(self, path: str):
        self.path = path


class KeyedReader(ds.DataSourceReader):
    def __init__(self, root: str, table: dict, manifest: dict, schema: T.StructType):
        self.root, self.table, self.manifest, self.names = root, table, manifest, schema.names
        self.known: list[Predicate] = []
        self.arrow = [(c["name"], f"key_{table['keys'].index(c['name'])}" if c["name"] in table["keys"] else f"{c['family']}__{c['qualifier']}") for c in table["columns"]]
        self.kinds = [c["kind"] for c in table["columns"]]

    def pushFilters(self, filters: list[ds.Filter]):
        self.known = [p for p in map(predicate_of, filters) if p is not None]
        yield from filters

    def partitions(self) -> list[Region]:
        regions = {int(r): path for r, path in self.manifest["regions"].items()}
        if self.known:
            kinds = {c["name"]: c["kind"] for c in self.table["columns"]}
            both = push_not(reduce(lambda a, b: a & b, self.known))
            wanted = regions_of(key_ranges(both, [(k, kinds[k]) for k in self.table["keys"]]), [tuple(s) for s in self.manifest["splits"]])
            regions = {r: regions[r] for r in wanted if r in regions}
        return [Region(regions[r]) for r in sorted(regions)]

    def read(self, partition: Region | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no region is left
            return
        fs, folder = pa.fs.FileSystem.from_uri(partition.path)
        for info in fs.get_file_info(pa.fs.FileSelector(folder)):
            if not info.base_name.endswith(".parquet"):
                continue
            with fs.open_input_file(info.path) as held:
                file = pa.parquet.ParquetFile(held)
                there = set(file.schema_arrow.names)
                for batch in file.iter_batches(columns=[p for _, p in self.arrow if p in there]):
                    yield pa.RecordBatch.from_arrays([batch.column(p) if p in there else pa.nulls(batch.num_rows, ARROW[k]) for (_, p), k in zip(self.arrow, self.kinds)], self.names)


#: Arrow's names of the stored types.
ARROW = {"string": pa.string(), "byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}


class KeyedSource(ds.DataSource):
    """Options: path (the root folder) and table."""

    @classmethod
    def name(cls) -> str:
        return "keystrata"

    def _metadata(self) -> tuple[str, dict, dict]:
        root, name = self.options.get("path"), self.options.get("table")
        if not root or not name:
            raise ValueError("keystrata: give the folder of the tables to load() and option table")
        fs, folder = pa.fs.FileSystem.from_uri(root)
        table = newest(fs, f"{folder}/_tables", f"{name}.", 2)
        manifest = newest(fs, f"{folder}/{table['namespace'] or 'default'}/{table['physical']}/_manifests", "", 1)
        for c in table["columns"]:
            stored = manifest["cells"].get(f"{c['family']}__{c['qualifier']}", c["kind"])
            if stored != c["kind"]:
                raise NotImplementedError(f"keystrata: {name}.{c['name']} is kept as {stored}; read it by a KeyedSession")
        return root, table, manifest

    def schema(self) -> T.StructType:
        _, table, _ = self._metadata()
        return T.StructType([T.StructField(c["name"], spark_type(c["kind"])) for c in table["columns"]])

    def reader(self, schema: T.StructType) -> KeyedReader:
        return KeyedReader(*self._metadata(), schema)
