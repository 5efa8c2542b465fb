"""Statistics that can be learned in parts: states that merge without the rows that they came from, and cubes of groups.

A state is a row per column of moments, bounds and sketches. States of parts are rows of one table, wherever and whenever
they were learned, and merge by an aggregation; so new data cost a pass over the new data only."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.selector import ColumnSelector
from .base import Columns, StatOperator, quoted

#: Precision of the sketch of distinct values, and of that of quantiles.
DISTINCT, RANKS = 14, 2000
#: Numbers whose sums are kept exactly are decimals of this kind.
_STATE = "column string, rows long, nulls long, mean double, m2 double, low double, high double, sum double, distinct_sketch binary, rank_sketch binary"


def state_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per numeric column: what is known of its values. One pass, one row per task and column in the shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("x")) for c in columns)))
    x = F.when(~F.isnan("x"), F.col("x"))
    rows = df.select(each.alias("v")).select("v.column", F.col("v.x").alias("x"))
    n = F.count(x)
    return rows.groupBy("column").agg(
        n.alias("rows"), (F.count("*") - n).alias("nulls"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.sum(x).alias("sum"), F.hll_sketch_agg(x.cast("string"), F.lit(DISTINCT)).alias("distinct_sketch"), F.kll_sketch_agg_double(x, F.lit(RANKS)).alias("rank_sketch"),
    )


def merged(states: DataFrame) -> DataFrame:
    """One row per column out of states of parts. The squares about the mean of all are those about each part's mean and
    those of the means."""
    w, total = F.col("rows"), states.groupBy("column").agg((F.sum("sum") / F.sum("rows")).alias("__mean"))
    around = F.coalesce("m2", F.lit(0.0)) + w * F.pow(F.coalesce("mean", "__mean") - F.col("__mean"), 2)
    return states.join(F.broadcast(total), "column").groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.max("__mean").alias("mean"), F.sum(F.when(w > 0, around)).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("sum").alias("sum"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("rank_sketch").alias("rank_sketch"),
    )


def read_off(states: DataFrame, quantiles: list[float] | None = None) -> DataFrame:
    """column, rows, nulls, mean, std (of a sample), low, high, sum, distinct (about 1 % off), quantiles (by rank, about
    0.1 % off)."""
    std = F.when((F.col("rows") > 1) & (F.col("low") == F.col("high")), F.lit(0.0)).when(F.col("rows") > 1, F.sqrt(F.col("m2") / (F.col("rows") - 1)))
    at = F.array(*(F.lit(float(q)) for q in quantiles or [0.25, 0.5, 0.75]))
    return states.select(
        "column", "rows", "nulls", "mean", std.alias("std"), "low", "high", "sum", F.hll_sketch_estimate("distinct_sketch").alias("distinct"),
        F.when(F.col("rows") > 0, F.kll_sketch_get_quantile_double("rank_sketch", at)).alias("quantiles"),
    )


class Standardize(StatOperator):
    """(x - mean) / std of the selected columns; 0 where all values are equal.

    Statistics are a state. With a storage path, each fit adds its state there, and what is used is all of it merged, so
    that fitting one part after another is fitting all; `forget` starts anew. Without one, a fit replaces the last."""

    output_dtype = "float64"  # type: ignore[assignment]

    def __init__(self) -> None:
        super().__init__()
        self.moments: dict[str, tuple[float | None, float | None]] = {}

    def fit(self, selector: ColumnSelector, df: DataFrame) -> list:
        learned = state_of(df, selector.names)
        if self.storage_path:
            learned.write.mode("append").parquet(self.storage_path)
            learned = merged(stored_states(df.sparkSession, self.storage_path))
        return read_off(learned).select("column", "mean", "std").collect()

    def fit_finalize(self, stats: list) -> None:
        self.moments = {r["column"]: (r["mean"], r["std"]) for r in stats}

    def clear(self) -> None:
        super().clear()
        self.moments = {}

    def load(self, spark: SparkSession) -> Standardize:
        """Takes what was stored, without a fit."""
        self.fit_finalize(read_off(merged(stored_states(spark, self.storage_path))).select("column", "mean", "std").collect())
        self.fitted = True
        return self

    def forget(self, spark: SparkSession) -> None:
        from ..sources.files import Files

        if self.storage_path and Files(spark, self.storage_path).exists():
            Files(spark, self.storage_path).delete("")
        self.clear()

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        self.require_fitted()
        return {n: self._scaled(columns[n].cast("double"), *self.moments.get(n, (None, None))) for n in selector.names}

    @staticmethod
    def _scaled(x: Column, mean: float | None, std: float | None) -> Column:
        if mean is None or not std:
            return F.when(x.isNotNull(), F.lit(0.0))
        return (x - F.lit(float(mean))) / F.lit(float(std))


def stored_states(spark: SparkSession, path: str | None) -> DataFrame:
    if not path:
        raise ValueError("no storage path is set")
    return spark.read.schema(_STATE.replace("column string", "`column` string")).parquet(path)


class Cube(StatOperator):
    """Learns aggregates for all combinations of the selected columns at once, with one exchange; data pass through.

    `results` has a row per combination of values, columns that a combination leaves out being null, and `__set`, a bit for
    each column left out, the last column's the lowest. `level` gives the rows of one combination, for encoders."""

    def __init__(self, depth: int | None = None, **aggregates: Any):
        super().__init__()
        self.depth, self.aggregates = depth, aggregates
        self.names: list[str] = []
        self.results: DataFrame | None = None

    def fit(self, selector: ColumnSelector, df: DataFrame) -> tuple[list[str], DataFrame]:
        from ..functions.frames import cut_lineage

        names = list(selector.names)
        columns = Columns.of(df)
        made = [f(columns).alias(n) for n, f in self.aggregates.items()]
        keys = [quoted(n) for n in names]
        sets = [s for s in range(1 << len(names)) if self.depth is None or len(names) - bin(s).count("1") <= self.depth]
        chosen = [[k for i, k in enumerate(keys) if not s >> len(names) - 1 - i & 1] for s in sets]
        grouped = df.cube(*keys) if self.depth is None else df.groupingSets(chosen, *keys)
        return names, cut_lineage(grouped.agg(F.grouping_id().cast("long").alias("__set"), *made))

    def fit_finalize(self, stats: tuple[list[str], DataFrame]) -> None:
        self.names, self.results = stats

    def clear(self) -> None:
        super().clear()
        self.results = None

    def level(self, *names: str) -> DataFrame:
        """The aggregates by some of the columns."""
        self.require_fitted()
        unknown = set(names) - set(self.names)
        if unknown or self.results is None:
            raise ValueError(f"no such columns in the cube: {sorted(unknown)}")
        out = sum(1 << len(self.names) - 1 - i for i, n in enumerate(self.names) if n not in names)
        return self.results.filter(F.col("__set") == out).select(*(quoted(n) for n in names), *self.aggregates)

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        self.require_fitted()
        return super().expressions(selector, columns)
