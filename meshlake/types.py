"""Variable types: their Spark types, sizes, ranges and default fill values."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Code, GridError


@dataclass(frozen=True)
class GridType:
    name: str
    number: int
    bytes: int
    spark: T.DataType
    fill: object
    low: object = None
    high: object = None
    classic: bool = False


# Type numbers, sizes and default fill values of the public array data model.
TYPES = {
    t.name: t
    for t in (
        GridType("byte", 1, 1, T.ByteType(), -127, -(2**7), 2**7 - 1, True),
        GridType("char", 2, 1, T.StringType(), "\0", classic=True),
        GridType("short", 3, 2, T.ShortType(), -32767, -(2**15), 2**15 - 1, True),
        GridType("int", 4, 4, T.IntegerType(), -2147483647, -(2**31), 2**31 - 1, True),
        GridType("float", 5, 4, T.FloatType(), 9.969209968386869e36, classic=True),
        GridType("double", 6, 8, T.DoubleType(), 9.969209968386869e36, classic=True),
        GridType("ubyte", 7, 1, T.ShortType(), 255, 0, 2**8 - 1),
        GridType("ushort", 8, 2, T.IntegerType(), 65535, 0, 2**16 - 1),
        GridType("uint", 9, 4, T.LongType(), 4294967295, 0, 2**32 - 1),
        GridType("int64", 10, 8, T.LongType(), -9223372036854775806, -(2**63), 2**63 - 1),
        GridType("uint64", 11, 8, T.DecimalType(20, 0), Decimal(18446744073709551614), 0, 2**64 - 1),
        GridType("string", 12, 8, T.StringType(), ""),
    )
}
ALIASES = {"real": "float", "text": "char", "schar": "byte", "uchar": "ubyte", "long": "int64", "longlong": "int64", "ulonglong": "uint64"}


def grid_type(name: str | int | GridType) -> GridType:
    if isinstance(name, GridType):
        return name
    if isinstance(name, int):
        name = next((t.name for t in TYPES.values() if t.number == name), "")
    found = TYPES.get(ALIASES.get(str(name).lower(), str(name).lower()))
    if found is None:
        raise GridError(Code.EBADTYPE, str(name))
    return found


def converted(column: Column, to: GridType, of: GridType | None = None) -> Column:
    """`column` as type `to`; numbers go towards zero, and what is out of range raises ERANGE when the row is read."""
    text = {"char", "string"}
    if of is not None and (of.name in text) != (to.name in text):
        raise GridError(Code.ECHAR, f"{of.name} to {to.name}")
    if to.low is None:
        return column.cast(to.spark)
    wide = column.cast("decimal(38,6)") if of is None or of.name in ("float", "double") else column.cast("decimal(38,0)")
    whole = F.when(wide >= 0, F.floor(wide)).otherwise(F.ceil(wide))
    bad = column.isNotNull() & ~F.coalesce(whole.between(F.lit(str(to.low)).cast("decimal(38,0)"), F.lit(str(to.high)).cast("decimal(38,0)")), F.lit(False))
    return F.when(bad, F.raise_error(F.lit("ERANGE: value out of range for " + to.name)).cast(to.spark)).otherwise(whole.cast(to.spark))


def fill_literal(t: GridType, value=None) -> Column:
    return F.lit(t.fill if value is None else value).cast(t.spark)
