"""List columns: flattening, padding, offsets, and their regular and ragged forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.base import quoted
from .frames import running_sum


def columnwise_explode(df: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """A list column as columns name_0, name_1, ...; the width is that of the longest list unless it is given."""
    if width is None:
        width = df.agg(F.max(F.size(quoted(column)))).first()[0] or 0
    rest = [quoted(c) for c in df.columns if c != column]
    return df.select(*rest, *(F.get(quoted(column), F.lit(i)).alias(f"{column}_{i}") for i in range(width)))


def flatten_lists(df: DataFrame, *columns: str) -> DataFrame:
    """explode_columns of all list columns, or of those named."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and (not columns or f.name in columns):
            df = columnwise_explode(df, f.name)
    return df


def flatten_list(df: DataFrame, column: str, levels: int | None = 1) -> DataFrame:
    """A row per element of a list column, alone; levels None: down to the innermost elements."""
    kind, c = df.schema[column].dataType, quoted(column)
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    for _ in range((depth if levels is None else levels) - 1):
        c = F.flatten(c)
    return df.select(F.explode(c).alias(column))


def pad(c: Column, width: int, value: Column) -> Column:
    """Lists cut or filled up to a length; null stays null."""
    return F.slice(F.concat(c, F.array_repeat(value, F.greatest(F.lit(0), F.lit(width) - F.size(c)))), 1, width)


def encode(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of every element; the lists keep their shape."""
    return F.transform(c, f)


def offsets(df: DataFrame, column: str, *order: str, name: str = "end_offset") -> DataFrame:
    """Adds where each row's list ends if all are put one after another in an order; null lists are empty."""
    return running_sum(df, F.coalesce(F.when(quoted(column).isNotNull(), F.size(quoted(column))), F.lit(0)), *map(quoted, order), name=name)


def multihot(df: DataFrame, keys: list[str], value: str, order: str, name: str | None = None) -> DataFrame:
    """The values of each key as a list, in an order. A key's list is one row, as lists are."""
    pairs = F.sort_array(F.collect_list(F.struct(quoted(order).alias("o"), quoted(value).alias("v"))))
    return df.groupBy(*map(quoted, keys)).agg(F.transform(pairs, lambda p: p["v"]).alias(name or value))


def regroup(flat: DataFrame, key: str, position: str, value: str, name: str) -> DataFrame:
    """Lists from rows (key, position, value)."""
    return multihot(flat, [key], value, position, name)


def positions(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, position, value) of a list column."""
    return df.select(quoted(key), F.posexplode(quoted(column)).alias("position", "value"))


def is_fixed(df: DataFrame, column: str) -> DataFrame:
    """One row: whether all lists have one length."""
    n = F.size(quoted(column))
    return df.agg((F.min(n) == F.max(n)).alias("is_fixed"))


def last_position(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy(*map(quoted, keys)).orderBy(quoted(order))) - 1)
