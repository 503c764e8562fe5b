"""Delimited text into the columns of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import from_text
from .catalog import Table


def read_text(spark: SparkSession, table: Table, path: str, separator: str = ",", local: bool = False) -> DataFrame:
    """Rows of the table from lines of text. The separator is a regular expression; empty lines are
    skipped, missing trailing fields and empty fields are NULL, more fields than columns and values that
    can't be read fail the job."""
    if local and "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    lines = spark.read.text(path).where(F.col("value") != "")
    fields = F.split("value", separator, -1)
    n = len(table.columns)
    line = F.concat(F.lit(f"{table.name} has {n} columns: "), F.col("value"))
    parts = lines.select(F.when(F.size(fields) > n, F.raise_error(line).cast("array<string>")).otherwise(fields).alias("f"))
    return parts.select(*(from_text(F.get("f", F.lit(i)), c.kind, f"{table.name}.{c.name}").alias(c.name) for i, c in enumerate(table.columns)))
