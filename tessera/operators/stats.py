"""Operators that learn statistics."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selector import ColumnSelector
from .base import Columns, StatOperator, quoted


class MinMaxScale(StatOperator):
    """(x - min) / (max - min); 0 where all values are equal."""

    output_dtype = "float64"  # type: ignore[assignment]

    def __init__(self) -> None:
        super().__init__()
        self.bounds: dict[str, tuple[float, float]] = {}

    def fit_expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        return {f"{how}_{n}": f(columns[n]) for n in selector.names for how, f in (("min", F.min), ("max", F.max))}

    def fit_finalize(self, stats: dict) -> None:
        names = [k[4:] for k in stats if k.startswith("min_")]
        self.bounds = {n: (stats[f"min_{n}"], stats[f"max_{n}"]) for n in names}

    def clear(self) -> None:
        super().clear()
        self.bounds = {}

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        self.require_fitted()
        return {n: self._scaled(columns[n].cast("double"), *self.bounds[n]) for n in selector.names}

    @staticmethod
    def _scaled(x: Column, low: Any, high: Any) -> Column:
        if low is None or low == high:
            return F.when(x.isNotNull(), F.lit(0.0))
        return (x - F.lit(float(low))) / F.lit(float(high) - float(low))


class ShiftToZero(StatOperator):
    """x - min."""

    def __init__(self) -> None:
        super().__init__()
        self.low: dict[str, Any] = {}

    def fit_expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        return {n: F.min(columns[n]) for n in selector.names}

    def fit_finalize(self, stats: dict) -> None:
        self.low = dict(stats)

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        self.require_fitted()
        return {n: columns[n] - F.lit(self.low[n]) for n in selector.names}


class FrequencyEncode(StatOperator):
    """Replaces values by their rank in the order of falling frequency, from 1 on, ties by value; null is 0.

    The vocabulary of each column is a DataFrame; it is joined, and broadcast if it is small enough for Spark to do so by
    the size that it estimates."""

    output_dtype = "int64"  # type: ignore[assignment]

    def __init__(self) -> None:
        super().__init__()
        self.vocabularies: dict[str, DataFrame] = {}

    def fit(self, selector: ColumnSelector, df: DataFrame) -> dict[str, DataFrame]:
        from ..functions.frames import cut_lineage, ranked

        out = {}
        for n in selector.names:
            counted = df.filter(quoted(n).isNotNull()).groupBy(quoted(n).alias("value")).agg(F.count("*").alias("n"))
            out[n] = cut_lineage(ranked(counted, F.desc("n"), F.asc("value"), name="code").select("value", "code"))
        return out

    def fit_finalize(self, stats: dict[str, DataFrame]) -> None:
        self.vocabularies = stats

    def clear(self) -> None:
        super().clear()
        self.vocabularies = {}

    def transform(self, selector: ColumnSelector, df: DataFrame) -> DataFrame:
        self.require_fitted()
        for i, n in enumerate(selector.names):
            codes = self.vocabularies[n].toDF(f"__value{i}", f"__code{i}")
            df = df.join(codes, quoted(n) == F.col(f"__value{i}"), "left").withColumn(n, F.coalesce(F.col(f"__code{i}"), F.lit(0)).cast("long")).drop(f"__value{i}", f"__code{i}")
        return df.select(*(quoted(n) for n in selector.names))


class Aggregate(StatOperator):
    """Only learns: named aggregates of the selected columns, kept in `results`; data pass through."""

    def __init__(self, **aggregates: Callable[[Columns], Column]):
        super().__init__()
        self.aggregates, self.results = aggregates, {}

    def fit_expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        return {n: f(columns) for n, f in self.aggregates.items()}

    def fit_finalize(self, stats: dict) -> None:
        self.results = dict(stats)

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        self.require_fitted()
        return super().expressions(selector, columns)
