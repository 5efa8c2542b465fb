"""Operators: what a graph does with the columns that reach a node."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import dtypes as D
from ..plans.schema import ColumnSchema, Schema
from ..plans.selector import ColumnSelector
from ..plans.tags import TagSet

if TYPE_CHECKING:
    from ..plans.node import Node


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Columns(Mapping):
    """Named columns over one DataFrame."""

    def __init__(self, base: DataFrame, columns: dict[str, Column]):
        self.base, self.columns = base, columns

    @classmethod
    def of(cls, df: DataFrame) -> Columns:
        return cls(df, {c: quoted(c) for c in df.columns})

    def __getitem__(self, name: str) -> Column:
        return self.columns[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.columns)

    def __len__(self) -> int:
        return len(self.columns)

    def only(self, names: list[str]) -> Columns:
        return Columns(self.base, {n: self.columns[n] for n in names})

    def frame(self) -> DataFrame:
        return self.base.select(*(c.alias(n) for n, c in self.columns.items()))


class Operator:
    """Passes columns on unchanged. Subclasses override `expressions` (columns to columns, compiled with all others into
    one projection) or `transform` (frame to frame, for what changes rows)."""

    #: Whether types of the output are known from data only.
    dynamic_dtypes = False

    # what it needs and makes
    @property
    def dependencies(self) -> list:
        """Names, selectors or nodes that it reads besides what it transforms."""
        return []

    @property
    def output_dtype(self) -> Any:
        return None

    @property
    def output_tags(self) -> list:
        return []

    @property
    def output_properties(self) -> dict:
        return {}

    @property
    def label(self) -> str:
        return type(self).__name__

    def column_mapping(self, selector: ColumnSelector) -> dict[str, list[str]]:
        """Output names to the names that they are made of."""
        return {n: [n] for n in selector.names}

    def output_column_names(self, selector: ColumnSelector) -> ColumnSelector:
        return ColumnSelector(list(self.column_mapping(selector)))

    def compute_selector(self, input_schema: Schema, selector: ColumnSelector) -> ColumnSelector:
        missing = [n for n in selector.names if n not in input_schema]
        if missing:
            raise ValueError(f"Missing column(s) {missing} in the input of {self.label}; there are {input_schema.column_names}")
        return selector.resolve(input_schema)

    def compute_output_schema(self, input_schema: Schema, selector: ColumnSelector) -> Schema:
        return Schema(self.compute_column_schema(out, [input_schema[n] for n in made_of if n in input_schema]) for out, made_of in self.column_mapping(selector).items())

    def compute_column_schema(self, name: str, sources: list[ColumnSchema]) -> ColumnSchema:
        out = sources[0].with_name(name) if sources else ColumnSchema(name)
        for s in sources[1:]:
            out = ColumnSchema(name, out.tags.override(s.tags), out.properties | {k: v for k, v in s.properties.items() if k != "value_count"}, out.dtype.without_shape, dims=out.shape.dims)
        if self.output_dtype is not None:
            kind = D.dtype(self.output_dtype)
            out = out.with_dtype(kind)
        elif self.dynamic_dtypes:
            out = ColumnSchema(name, out.tags, {k: v for k, v in out.properties.items() if k != "value_count"})
        if self.output_tags:
            out = out.with_tags(TagSet(self.output_tags))
        if self.output_properties:
            out = out.with_properties(self.output_properties)
        return out

    # what it does
    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        return {n: columns[n] for n in selector.names}

    def transform(self, selector: ColumnSelector, df: DataFrame) -> DataFrame:
        columns = Columns.of(df)
        return Columns(df, self.expressions(selector, columns)).frame()

    @property
    def changes_rows(self) -> bool:
        """Whether `transform` is its own and so ends a projection."""
        return type(self).transform is not Operator.transform

    # artifacts and export
    def load_artifacts(self, path: str | None = None) -> None:
        """For operators that keep something on disk."""

    def save_artifacts(self, path: str | None = None) -> None:
        """For operators that keep something on disk."""

    @property
    def exportable(self) -> bool:
        return True

    def export(self, path: str, input_schema: Schema, output_schema: Schema) -> dict:
        """A description of the operator, for plans that are written down."""
        return {"operator": type(self).__name__, "label": self.label, "inputs": input_schema.column_names, "outputs": output_schema.column_names}

    def create_node(self, selector: Any) -> Node:
        from ..plans.node import Node

        return Node.of(selector) >> self

    def __rrshift__(self, other: Any) -> Node:
        return self.create_node(other)

    def __repr__(self) -> str:
        return self.label


class StatOperator(Operator):
    """An operator that learns something of the data first.

    Statistics that are aggregates are given by `fit_expressions`; those of all operators that can be fitted at a time are
    computed in one job. Anything else overrides `fit`. `fit_finalize` gets what either returned."""

    def __init__(self) -> None:
        self.fitted = False
        self.storage_path: str | None = None

    def fit_expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        raise NotImplementedError

    def fit(self, selector: ColumnSelector, df: DataFrame) -> Any:
        aggregates = self.fit_expressions(selector, Columns.of(df))
        row = df.agg(*(c.alias(n) for n, c in aggregates.items())).first()
        return dict(zip(aggregates, row, strict=True))

    @property
    def fits_by_aggregates(self) -> bool:
        return type(self).fit is StatOperator.fit

    def fit_finalize(self, stats: Any) -> None:
        raise NotImplementedError

    def clear(self) -> None:
        self.fitted = False

    def set_storage_path(self, path: str, copy: bool = False) -> None:
        self.storage_path = path

    def require_fitted(self) -> None:
        if not self.fitted:
            raise RuntimeError(f"{self.label} must be fitted before it transforms")
