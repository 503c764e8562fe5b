"""Physical tables: Parquet files, one folder for each region and version, sorted by key.

A region holds the keys from its lower split key on and below the next. A manifest names the folder of
each region; a write makes new folders for the regions that it touches and then a new manifest, so
readers see all of a write or nothing, and no file is read and written at once.

Physical columns are ``key_0`` … for the key and ``family__qualifier`` for cells. Several logical tables
may share them. Tables in string format keep their cells as text.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import spark_type
from .catalog import Table, cell_name
from .files import Files

SEQ, OLD, WHOLE = "_seq", "_old", "_whole"
#: Split keys that a nested comparison takes; with more, an array of split keys is searched.
NESTED = 64


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark)

    # -- physical tables

    def place(self, table: Table) -> str:
        return f"{self.root}/{table.namespace or 'default'}/{table.physical}"

    def manifest(self, table: Table) -> dict | None:
        folder = f"{self.place(table)}/_manifests"
        versions = [n for n in self.files.names(folder) if n.endswith(".json") and n.count(".") == 1]
        return self.files.read(f"{folder}/{versions[-1]}") if versions else None

    def _commit(self, table: Table, manifest: dict) -> None:
        """Fails if another writer made the same version first."""
        manifest["version"] += 1
        self.files.make(f"{self.place(table)}/_manifests")
        self.files.write(f"{self.place(table)}/_manifests/{manifest['version']:010d}.json", manifest)

    def create(self, table: Table, splits: Sequence[tuple] = (), families: Sequence[str] = ()) -> None:
        """Make the physical table, or check that one that is there has the families and key."""
        now = self.manifest(table)
        needed = sorted({c.family for c in table.cells} | set(families))
        kinds = [k for _, k in table.key_types]
        if now is None:
            rows = [list(s) if isinstance(s, (tuple, list)) else [s] for s in splits]
            if sorted(map(tuple, rows)) != list(map(tuple, rows)):
                raise ValueError("split keys must ascend")
            self._commit(table, {"version": 0, "keys": kinds, "families": needed, "splits": rows, "cells": {}, "regions": {}})
            return
        missing = [f for f in needed if f not in now["families"]]
        if missing:
            raise ValueError(f"{table.physical} has no column family {', '.join(missing)}")
        if now["keys"] != kinds:
            raise ValueError(f"{table.physical} has a key of {', '.join(now['keys'])}")

    def splits(self, table: Table) -> list[tuple]:
        return [tuple(s) for s in (self.manifest(table) or {"splits": []})["splits"]]

    # -- reading

    def _held(self, manifest: dict) -> T.StructType:
        keys = [T.StructField(f"key_{i}", spark_type(k)) for i, k in enumerate(manifest["keys"])]
        return T.StructType(keys + [T.StructField(n, spark_type(k)) for n, k in manifest["cells"].items()])

    def _rows(self, manifest: dict, regions: Sequence[int] | None) -> DataFrame:
        paths = [p for r, p in sorted(manifest["regions"].items(), key=lambda x: int(x[0])) if regions is None or int(r) in regions]
        schema = self._held(manifest)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: Table, regions: Sequence[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The logical table's rows, of all regions or those given; of the newest manifest, or that given."""
        manifest = manifest or self.manifest(table)
        rows = self._rows(manifest, regions)
        columns = []
        for c in table.columns:
            if c.name in table.keys:
                column = F.col(f"key_{table.keys.index(c.name)}")
            elif cell_name(c) in manifest["cells"]:
                column = F.col(cell_name(c))
                if manifest["cells"][cell_name(c)] != c.kind:
                    column = column.try_cast(spark_type(c.kind))
            else:
                column = F.lit(None).cast(spark_type(c.kind))
            columns.append(column.alias(c.name, metadata={} if c.family is None else {"family": c.family, "qualifier": c.qualifier}))
        return rows.select(*columns)

    # -- writing

    def region(self, splits: Sequence[Sequence], keys: Sequence[SparkColumn], kinds: Sequence[str]) -> SparkColumn:
        """Number of the region that a key lies in: how many split keys are at or below it. A few split keys are
        compared by halves in code of their own. Many are held as an array, so that the expression doesn't grow with
        them, and are searched by halves too."""
        if len(splits) > NESTED:
            names = [f"k{i}" for i in range(len(kinds))]
            kind = ", ".join(f"{n}: {spark_type(k).simpleString()}" for n, k in zip(names, kinds))
            rows = [dict(zip(names, [*s, *[None] * len(kinds)])) for s in splits]  # a missing column comes before all keys
            held = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")  # folded to a constant
            own = F.struct(*(k.cast(spark_type(t)).alias(n) for k, t, n in zip(keys, kinds, names)))
            steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(splits).bit_length()))))
            # beyond the last split key get() is NULL, and the step isn't taken
            return F.aggregate(steps, F.lit(0), lambda below, step: F.when(F.get(held, below + step - 1) <= own, below + step).otherwise(below))

        def reached(split: Sequence) -> SparkColumn:
            parts = []
            for i, v in enumerate(split):
                equal = [keys[j] == F.lit(split[j]) for j in range(i)]
                here = keys[i] >= F.lit(v) if i == len(split) - 1 else keys[i] > F.lit(v)
                parts.append(reduce(lambda a, b: a & b, [*equal, here]))
            return reduce(lambda a, b: a | b, parts)

        def between(low: int, high: int) -> SparkColumn:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(reached(splits[middle]), between(middle + 1, high)).otherwise(between(low, middle))

        return between(0, len(splits))

    def write(self, table: Table, rows: DataFrame, merge_cells: bool = False) -> None:
        """Upsert by key. Rows have the logical table's columns by name; of several with one key the
        last wins. Else a whole row is replaced, NULLs included; with merge_cells a NULL leaves the old
        cell. Cells that the logical table does not map stay as they are."""
        manifest = self.manifest(table)
        names = {k: f"key_{i}" for i, k in enumerate(table.keys)}
        text = table.form == "stringformat"
        columns = []
        for c in table.columns:
            value = F.col(f"`{c.name}`").cast(spark_type(c.kind))
            if c.name in names:
                value = F.when(value.isNull(), F.raise_error(F.lit(f"NULL in key column {c.name} of {table.name}")).cast(spark_type(c.kind))).otherwise(value)
            elif c.kind == "string":
                value = F.nullif(value, F.lit(""))
            columns.append((value.cast("string") if text and c.name not in names else value).alias(names.get(c.name) or cell_name(c)))
        for c in table.cells:
            manifest["cells"].setdefault(cell_name(c), "string" if text else c.kind)
        keys = [names[k] for k in table.keys]
        kinds = manifest["cells"]
        own = {cell_name(c) for c in table.cells}
        new = rows.select(*columns, F.monotonically_increasing_id().alias(SEQ))
        new = new.select(*keys, *(F.col(n).cast(spark_type(kinds[n])).alias(n) for n in own), SEQ)
        region = self.region(manifest["splits"], [F.col(k) for k in keys], manifest["keys"])
        # the source is evaluated once: what follows reads the staged rows, so all of it sees the same ones
        staging, path = (f"{self.place(table)}/{what}-{uuid.uuid4().hex}" for what in ("staging", "data"))
        try:
            new.write.parquet(staging)
            new = self.spark.read.schema(new.schema).parquet(staging)
            self._merge(table, manifest, new, keys, own, region, merge_cells, path)
            self._commit(table, manifest)
        except Exception:
            self.files.delete(path)
            raise
        finally:
            self.files.delete(staging)

    def _merge(self, table: Table, manifest: dict, new: DataFrame, keys: list[str], own: set[str], region: SparkColumn, merge_cells: bool, path: str) -> None:
        """Write the touched regions, old rows and new ones, to path, and name them in the manifest."""
        kinds = manifest["cells"]
        touched = [r[0] for r in new.select(region.alias("r")).distinct().collect()]  # one row a region at most
        old = self._rows(manifest, touched).withColumn(SEQ, F.lit(-1).cast("long"))
        both = old.unionByName(new, allowMissingColumns=True)
        cells, whole = [], [] if merge_cells else [f"`{n}`" for n in kinds if n in own]
        if whole:  # all in one, so that an aggregate row holds SEQ once
            cells.append(F.expr(f"max_by(struct({', '.join(whole)}), {SEQ})").alias(WHOLE))
        for n in kinds:
            if n not in own:
                cells.append(F.expr(f"max_by(`{n}`, {SEQ}) FILTER (WHERE {SEQ} = -1)").alias(n))
            elif merge_cells:
                cells.append(F.expr(f"max_by(`{n}`, {SEQ}) FILTER (WHERE `{n}` IS NOT NULL)").alias(n))
        merged = both.groupBy(*keys).agg(*cells) if cells else both.select(*keys).distinct()
        if whole:
            merged = merged.select(*keys, *(F.col(f"{WHOLE}.`{n}`" if f"`{n}`" in whole else f"`{n}`").alias(n) for n in kinds))
        ordered = merged.withColumn("region", region)
        if manifest["splits"]:
            ordered = ordered.repartitionByRange("region", *keys)
        else:
            ordered = ordered.repartitionByRange(*keys)
        ordered.sortWithinPartitions("region", *keys).write.partitionBy("region").parquet(path)
        for name in self.files.names(path):
            if name.startswith("region="):
                manifest["regions"][name.removeprefix("region=")] = f"{path}/{name}"

    def split(self, table: Table, max_bytes: int) -> list[tuple]:
        """Cut each region of more than max_bytes at quantiles of the key's leading column, as far as its values
        allow. Only such regions are rewritten; returns the new split keys.

        Their rows are staged once in key order, so a row's place says which quantiles it lies between and no row
        is compared with all split keys."""
        manifest = self.manifest(table)
        keys = [f"key_{i}" for i in range(len(manifest["keys"]))]
        sizes = {int(r): sum(n for _, n in self.files.sizes(place)) for r, place in manifest["regions"].items()}
        wanted = {r: -(-size // max_bytes) for r, size in sizes.items() if size > max_bytes}
        if not wanted:
            return []
        staging, path = (f"{self.place(table)}/{what}-{uuid.uuid4().hex}" for what in ("staging", "data"))
        try:
            old = self.region(manifest["splits"], [F.col(k) for k in keys], manifest["keys"])
            ordered = self._rows(manifest, list(wanted)).withColumn(OLD, old).repartitionByRange(*keys).sortWithinPartitions(*keys)
            ordered = ordered.withColumn(SEQ, F.monotonically_increasing_id())  # a partition's number and the place in it
            ordered.write.parquet(staging)
            ranked = self._ranked(self.spark.read.schema(ordered.schema).parquet(staging), wanted)
            quantiles: dict[int, list] = {}
            # the first row behind each quantile, and the region's first row
            for r, slot, v in ranked.where("_rank = 0 OR _slot > (_rank - 1) * _wanted DIV _total").select(OLD, "_slot", "key_0").collect():
                quantiles.setdefault(r, []).append((slot, v))
            added = {r: sorted({v for _, v in found if v == v} - {min(found)[1]}) for r, found in quantiles.items()}  # no cut at NaN
            added = {r: v for r, v in added.items() if v}
            if not added:
                return []
            grown = sorted(added)
            upto = list(accumulate((len(added[r]) for r in grown), initial=0))
            number = lambda r: r + upto[bisect_left(grown, r)]  # noqa: E731  as many new split keys lie below it as in the regions before it
            # for each slot between two quantiles: the regions of its rows, and of those that equal the next quantile
            slots = []
            for r in grown:
                found = [(slot, v, number(r) + (bisect_right(added[r], v) if v == v else len(added[r]))) for slot, v in sorted(quantiles[r])]
                slots += [(r, slot, here, after, there) for (slot, _, here), (_, after, there) in zip(found, [*found[1:], (None, None, None)])]
            kind = spark_type(manifest["keys"][0]).simpleString()
            slots = self.spark.createDataFrame(slots, f"{OLD} int, _slot bigint, _here int, _next {kind}, _there int")
            region = F.when(F.col("key_0") == F.col("_next"), F.col("_there")).otherwise(F.col("_here"))
            cut = ranked.join(F.broadcast(slots), [OLD, "_slot"]).select(*self._held(manifest).names, region.alias("region"))
            cut.sortWithinPartitions("region", *keys).write.partitionBy("region").parquet(path)
            fresh = sorted((v,) for values in added.values() for v in values)
            moved = {str(number(int(r))): place for r, place in manifest["regions"].items() if int(r) not in added}
            for name in self.files.names(path):
                if name.startswith("region="):
                    moved[name.removeprefix("region=")] = f"{path}/{name}"
            manifest["splits"] = [list(x) for x in sorted([*map(tuple, manifest["splits"]), *fresh])]
            manifest["regions"] = moved
            self._commit(table, manifest)
            return fresh
        except Exception:
            self.files.delete(path)
            raise
        finally:
            self.files.delete(staging)

    def _ranked(self, staged: DataFrame, wanted: dict[int, int]) -> DataFrame:
        """Rows staged in key order with their region's row count and wanted parts, their rank in the region and the
        part (slot) that the rank falls into. The driver sees one row for each region in a partition."""
        part = F.shiftright(SEQ, 33).cast("int")
        runs = staged.groupBy(OLD, part.alias("_part")).agg(F.count("*"), F.min(SEQ)).collect()
        total: dict[int, int] = {}
        starts = []
        for r, p, n, first in sorted(map(tuple, runs)):
            starts.append((r, p, total.get(r, 0) - first))
            total[r] = total.get(r, 0) + n
        starts = self.spark.createDataFrame([(r, p, shift, total[r], wanted[r]) for r, p, shift in starts], f"{OLD} int, _part int, _shift bigint, _total bigint, _wanted bigint")
        ranked = staged.withColumn("_part", part).join(F.broadcast(starts), [OLD, "_part"]).withColumn("_rank", F.col(SEQ) + F.col("_shift"))
        return ranked.withColumn("_slot", F.expr("_rank * _wanted DIV _total"))

    def compact(self, table: Table, keep_seconds: float = 3600) -> None:
        """Delete the manifests that were replaced more than keep_seconds ago, and all folders that none of
        the others names. Readers that planned within that time still find their files, and writes younger than
        that aren't disturbed."""
        folder = f"{self.place(table)}/_manifests"
        held = [(n, t) for n, t in self.files.ages(folder) if n.endswith(".json") and n.count(".") == 1]
        limit = time.time() - keep_seconds
        kept = [n for i, (n, _) in enumerate(held) if i == len(held) - 1 or held[i + 1][1] > limit]
        used = {p.split("/")[-2] for n in kept for p in self.files.read(f"{folder}/{n}")["regions"].values()}
        for n, _ in held:
            if n not in kept:
                self.files.delete(f"{folder}/{n}")
        for name, changed in self.files.ages(self.place(table)):
            if name.startswith(("data-", "staging-")) and name not in used and changed <= limit:
                self.files.delete(f"{self.place(table)}/{name}")
