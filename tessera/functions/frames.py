"""What user code does with whole frames, as plans that stay distributed."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.base import quoted


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder shared by driver and executors, which spark.checkpoint.dir names. Only a session on one machine, for
    which none is set, gets a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _in_order(df: DataFrame, order: tuple, extra: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows in order with __part and __i, their place in the part; and what comes before each part: rows and sums of
    `extra`. No task gets more than a range of the rows, and the driver a row for each part."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = df.select("*", *(c.alias(k) for k, c in extra.items())).repartitionByRange(n, *order).sortWithinPartitions(*order)
    line = cut_lineage(line.withColumn("__id", F.monotonically_increasing_id()))
    line = line.withColumn("__part", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")
    parts = sorted(map(tuple, line.groupBy("__part").agg(F.count("*"), *(F.sum(k) for k in extra)).collect()))
    rows, before = [], [0] * (1 + len(extra))
    for part, *sums in parts:
        rows.append((part, *before))
        before = [a + (b or 0) for a, b in zip(before, sums, strict=True)]
    kinds = ", ".join(f"__before{i} {'long' if i == 0 else line.schema[k].dataType.simpleString()}" for i, k in enumerate(["rows", *extra]))
    return line, spark.createDataFrame(rows, f"__part long, {kinds}")


def ranked(df: DataFrame, *order: Any, name: str = "rank", start: int = 1) -> DataFrame:
    """Adds the place of each row in an order, without a window over all rows."""
    line, before = _in_order(df, order, {})
    return line.join(F.broadcast(before), "__part").select(*(quoted(c) for c in df.columns), (F.col("__i") + F.col("__before0") + F.lit(start)).alias(name))


def running_sum(df: DataFrame, value: Column, *order: Any, name: str = "running") -> DataFrame:
    """Adds the sum of a whole-number value over the rows up to each one in an order."""
    line, before = _in_order(df, order, {"__value": value.cast("long")})
    here = F.sum("__value").over(W.partitionBy("__part").orderBy("__i").rowsBetween(W.unboundedPreceding, 0))
    return line.withColumn(name, here).join(F.broadcast(before), "__part").select(*(quoted(c) for c in df.columns), (F.col(name) + F.col("__before1")).alias(name))


def concat_rows(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def add_to_column(df: DataFrame, column: str, values: list, prepend: bool = False) -> DataFrame:
    """Further rows that have only this column, after the others or before them."""
    more = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(column, df.schema[column].dataType)]))
    return concat_rows(more, df).select(*map(quoted, df.columns)) if prepend else concat_rows(df, more)


def describe(df: DataFrame, *stats: str) -> DataFrame:
    return df.summary(*stats)


def explode(df: DataFrame, column: str) -> DataFrame:
    """A row per element; an empty or null list gives one with null."""
    return df.withColumn(column, F.explode_outer(quoted(column)))


def groupby(df: DataFrame, keys: list[str], dropna: bool = True) -> Any:
    """Groups by keys; rows with a null key are left out unless dropna is false."""
    if dropna:
        for k in keys:
            df = df.filter(quoted(k).isNotNull())
    return df.groupBy(*map(quoted, keys))


def reduce_columns(df: DataFrame, how: str, columns: list[str] | None = None, q: float = 0.5) -> DataFrame:
    """One row: max, min, mean, median, sum, product, std, var, count or quantile (exact, linear) of columns. Quantiles are
    read off the order of the values, of which no task holds more than a range."""
    if how in ("median", "quantile"):
        spark = df.sparkSession
        row = [_order_statistic(df, c, 0.5 if how == "median" else q) for c in columns or df.columns]
        return spark.createDataFrame([tuple(row)], ", ".join(f"`{c}` double" for c in columns or df.columns))
    made: dict[str, Callable[[Column], Column]] = {
        "max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "product": F.product,
        "std": F.stddev_samp, "var": F.var_samp, "count": F.count,
    }
    return df.agg(*(made[how](quoted(c)).alias(c) for c in columns or df.columns))


def _order_statistic(df: DataFrame, column: str, q: float) -> float | None:
    """The quantile of a column, on the line between the two values beside it; null without values."""
    line, before = _in_order(df.select(quoted(column).cast("double").alias("x")).filter("x IS NOT NULL"), (F.col("x"),), {})
    n = line.count()
    if not n:
        return None
    at = q * (n - 1)
    low = int(at)
    place = F.col("__i") + F.col("__before0")
    found = line.join(F.broadcast(before), "__part").filter((place >= low) & (place <= low + 1)).select("x").collect()
    values = sorted(r["x"] for r in found)
    return values[0] + (at - low) * (values[-1] - values[0])


def interpolate(df: DataFrame, column: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """Fills nulls on the line between the values before and after, by position in an order within each key; after the
    last value it stays, and before the first null stays. Neither rows nor a key need to fit in a task."""
    from .segments import Segments

    rows = Segments(df, keys, [order])
    rows.interpolate(column, "__line")
    return rows.frame(replace={column: "__line"})


def shift(df: DataFrame, column: str, order: str, periods: int = 1, keys: list[str] | None = None) -> DataFrame:
    """The value that came so many rows before in an order, within each key or over all rows. Neither rows nor a key need
    to fit in a task."""
    from .segments import Segments

    rows = Segments(df, keys, [order])
    rows.shift(column, periods, "__shifted")
    return rows.frame(replace={column: "__shifted"})


def pivot(df: DataFrame, index: list[str], columns: str, values: str, how: str = "first", known: list | None = None) -> DataFrame:
    agg = {"first": F.first, "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}[how]
    return df.groupBy(*map(quoted, index)).pivot(columns, known).agg(agg(quoted(values)))


def replace(df: DataFrame, old: Any, new: Any, columns: list[str] | None = None) -> DataFrame:
    return df.replace(old, new, columns)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    return F.xxhash64(*(F.to_json(F.struct(quoted(f.name))) if isinstance(f.dataType, T.MapType) else quoted(f.name) for f in df.schema.fields), F.lit(seed))


def shuffled(df: DataFrame, size: int | None = None, seed: int = 0, keep_order: bool = False) -> DataFrame:
    """Rows in an order that looks random, or a sample of exactly `size` of them. The order is a hash of row and seed,
    which stays the same if a task is tried again."""
    out = df.orderBy(row_hash(df, seed))
    return out.limit(size) if size is not None else out


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """n rows exactly, or about a fraction."""
    return shuffled(df, n, seed) if n is not None else df.sample(fraction=fraction, seed=seed)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def transpose(df: DataFrame, index: str | None = None) -> DataFrame:
    return df.transpose(quoted(index)) if index else df.transpose()


def to_dict(df: DataFrame) -> dict[str, list]:
    """All values on the driver."""
    return df.toArrow().to_pydict()


def to_numpy(df: DataFrame):
    """All values on the driver, a row per row."""
    import numpy as np

    table = df.toArrow()
    return np.stack([table[c].to_numpy() for c in table.column_names], 1) if table.num_columns else np.empty((table.num_rows, 0))


def apply(df: DataFrame, f: Callable, schema: Any) -> DataFrame:
    """f over pandas DataFrames of some rows each."""

    def run(frames):
        for pdf in frames:
            yield f(pdf)

    return df.mapInPandas(run, schema)


def pipe(df: DataFrame, f: Callable, *args: Any, **kwargs: Any) -> DataFrame:
    return f(df, *args, **kwargs)


def from_dict(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A frame of columns in memory."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))


def arange(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "id") -> DataFrame:
    """Whole numbers, made where they are needed."""
    return spark.range(start, stop, step).toDF(name)


def filled(df: DataFrame, name: str, value: Any, kind: str | None = None) -> DataFrame:
    """Adds a column of one value."""
    c = F.lit(value)
    return df.withColumn(name, c.cast(kind) if kind else c)
