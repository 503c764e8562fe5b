"""Logical tables: names, ordered columns, keys and mappings, kept as one small file for each version.

A change writes the next version and then deletes the older ones, so a crash in between loses nothing, and of
two writers of one version the second fails.
Names are case-sensitive. Dropping a table removes its entry only; its physical table stays and can be
mapped again, also by several logical tables at once.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..functions.types import canonical, spark_type
from ..plans.statements import Column, CreateTable
from .files import Files


@dataclass(frozen=True)
class Table:
    name: str
    namespace: str
    physical: str
    columns: tuple[Column, ...]  # in SQL order; keys have no family
    keys: tuple[str, ...]  # in key order
    form: str

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.name} has no column {name}")

    @property
    def cells(self) -> list[Column]:
        return [c for c in self.columns if c.name not in self.keys]

    @property
    def key_types(self) -> list[tuple[str, str]]:
        return [(k, self.column(k).kind) for k in self.keys]

    def schema(self) -> T.StructType:
        of = lambda c: {} if c.family is None else {"family": c.family, "qualifier": c.qualifier}
        return T.StructType([T.StructField(c.name, spark_type(c.kind), c.name not in self.keys, of(c)) for c in self.columns])


def cell_name(c: Column) -> str:
    """The physical column of a cell."""
    return f"{c.family}__{c.qualifier}"


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.files, self.folder = Files(spark), f"{root}/_tables"
        self.files.make(self.folder)

    def _versions(self) -> dict[str, list[str]]:
        """The files of each table, oldest first."""
        found: dict[str, list[str]] = {}
        for n in self.files.names(self.folder):
            if n.endswith(".json") and n.count(".") == 2:
                found.setdefault(n.split(".")[0], []).append(n)
        return found

    def names(self) -> list[str]:
        return sorted(self._versions())

    def exists(self, name: str) -> bool:
        return name in self._versions()

    def get(self, name: str) -> Table:
        held = self._versions().get(name)
        if not held:
            raise LookupError(f"can not find table {name}")
        d = self.files.read(f"{self.folder}/{held[-1]}")
        return Table(d["name"], d["namespace"], d["physical"], tuple(Column(**c) for c in d["columns"]), tuple(d["keys"]), d["form"])

    def create(self, made: CreateTable) -> Table:
        if self.exists(made.name):
            raise ValueError(f"Logical table {made.name} exists already")
        columns = tuple(replace(c, kind=canonical(c.kind)) for c in made.columns)
        table = Table(made.name, made.namespace, made.physical, columns, made.keys, made.form)
        self.files.write(f"{self.folder}/{table.name}.000001.json", asdict(table))
        return table

    def drop(self, name: str) -> None:
        held = self._versions().get(name)
        if not held:
            raise LookupError(f"Logical table {name} does not exist")
        for n in held:  # the newest last
            self.files.delete(f"{self.folder}/{n}")

    def add_column(self, name: str, column: Column) -> Table:
        table = self.get(name)
        if any(c.name == column.name for c in table.columns):
            raise ValueError(f"{name} has a column {column.name} already")
        return self._save(replace(table, columns=(*table.columns, replace(column, kind=canonical(column.kind)))))

    def drop_column(self, name: str, column: str) -> Table:
        table = self.get(name)
        table.column(column)
        if column in table.keys:
            raise ValueError(f"{column} is part of the key of {name}")
        return self._save(replace(table, columns=tuple(c for c in table.columns if c.name != column)))

    def _save(self, table: Table) -> Table:
        held = self._versions()[table.name]
        self.files.write(f"{self.folder}/{table.name}.{int(held[-1].split('.')[1]) + 1:06d}.json", asdict(table))
        for n in held:
            self.files.delete(f"{self.folder}/{n}")
        return table
