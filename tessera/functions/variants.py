"""Columns of any shape: text of JSON as variants, and paths in them as columns of a type."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import quoted
from ..plans import dtypes as D


def parsed(text: Column) -> Column:
    """A variant; null where the text is no JSON."""
    return F.try_parse_json(text)


def at(value: Column, path: str, dtype: Any) -> Column:
    """What a variant has at a path, `$.a[0].b`, as a type; null where there is nothing or something of another kind."""
    kind = D.dtype(dtype).to_spark
    if kind is None:
        raise ValueError(f"{dtype} is no type of a column")
    return F.try_variant_get(value, path, kind.simpleString())


def with_paths(df: DataFrame, column: str, paths: dict[str, tuple[str, Any]], keep: bool = True) -> DataFrame:
    """Adds a column for each path: name to (path, type). A column of text is parsed once for all of them."""
    text = df.schema[column].dataType.typeName() == "string"
    name = "__variant"
    while name in df.columns:
        name += "_"
    held = df.withColumn(name, parsed(quoted(column)) if text else quoted(column))
    made = held.select("*", *(at(F.col(name), p, t).alias(n) for n, (p, t) in paths.items())).drop(name)
    return made if keep else made.drop(column)


def kinds(df: DataFrame, column: str) -> str:
    """One schema that fits all values of a column, in Spark's words; merged within tasks, then over them."""
    text = df.schema[column].dataType.typeName() == "string"
    value = parsed(quoted(column)) if text else quoted(column)
    return df.select(value.alias("v")).agg(F.schema_of_variant_agg("v")).first()[0]
