"""The column types of keyed tables: names in DDL, Spark types, and conversions from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The type names that DDL knows for stored columns.
STORED = {
    "string": T.StringType(),
    "tinyint": T.ByteType(),
    "byte": T.ByteType(),
    "short": T.ShortType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
}
#: Names that the grammar takes and the catalog refuses.
REFUSED = {"binary", "decimal", "date", "timestamp", "varchar"}
#: Whole-number types and their widths in bits.
INTEGRAL = {"byte": 8, "short": 16, "int": 32, "long": 64}


def canonical(name: str) -> str:
    """The engine's name of a DDL type; an error for types that can't be stored."""
    t = STORED.get(name.lower())
    if t is None:
        raise ValueError(f"Unrecognized data type {name}")
    return t.typeName() if not isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else {T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long"}[type(t)]


def spark_type(name: str) -> T.DataType:
    return STORED[name]


def from_text(text: Column, kind: str, what: str) -> Column:
    """A typed value from text: '' is NULL, anything that can't be read fails the job."""
    value = F.nullif(text, F.lit("")) if kind == "string" else F.nullif(F.trim(text), F.lit(""))
    if kind == "string":
        return value
    cast = value.try_cast(STORED[kind])
    if kind == "byte":  # a number, or else one character for its code point
        one = (F.length(value) == 1) & (F.ascii(value) < 128)
        cast = F.when(cast.isNull() & one, F.ascii(value).cast("tinyint")).otherwise(cast)
    wrong = F.raise_error(F.concat(F.lit(f"{what}: not a {kind}: "), value)).cast(STORED[kind])
    return F.when(value.isNotNull() & cast.isNull(), wrong).otherwise(cast)


def bounds_of(kind: str) -> tuple[int, int] | None:
    """Least and largest value of a whole-number type."""
    bits = INTEGRAL.get(kind)
    return None if bits is None else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)
