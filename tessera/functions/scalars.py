"""Functions of single columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.base import quoted


def hex_to_int(c: Column, kind: str = "int") -> Column:
    """Hexadecimal text to a signed number of 32 bits, which wraps; null stays null."""
    wide = F.conv(c, 16, 10).cast("decimal(20,0)")
    wrapped = F.pmod(wide + F.lit(2**31).cast("decimal(20,0)"), F.lit(2**32).cast("decimal(20,0)")) - F.lit(2**31).cast("decimal(20,0)")
    return wrapped.cast("long").cast(kind)


def hash_series(c: Column) -> Column:
    """64 bits that are the same for equal values in all tasks and sessions."""
    return F.xxhash64(c)


def has_nulls(c: Column) -> Column:
    """Aggregate: whether a column has a null."""
    return F.coalesce(F.bool_or(c.isNull()), F.lit(False))


def is_list_dtype(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def is_string_dtype(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def list_val_dtype(df: DataFrame, column: str) -> T.DataType | None:
    """Type of a list's innermost elements."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        return None
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def random_uniform(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    return F.rand(seed) * F.lit(high - low) + F.lit(low)


def to_datetime(c: Column, unit: str = "s") -> Column:
    """Naive timestamps from numbers of s, ms or us since 1970."""
    per = {"s": 1_000_000, "ms": 1000, "us": 1}[unit]
    return F.to_timestamp_ntz(F.date_format(F.timestamp_micros((c * F.lit(per)).cast("long")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def column(name: str) -> Column:
    return quoted(name)
