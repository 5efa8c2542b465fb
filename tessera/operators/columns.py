"""Operators over columns: selection, concatenation, subtraction, renaming, metadata, user functions, subgraphs."""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import dtypes as D
from ..plans.schema import Schema
from ..plans.selector import ColumnSelector
from ..plans.tags import Tags
from .base import Columns, Operator


class SelectionOp(Operator):
    """Columns of the root, by name, tag or wildcard."""

    def __init__(self, selector: Any = "*"):
        self.selector = selector if isinstance(selector, ColumnSelector) else ColumnSelector(selector)

    def compute_selector(self, input_schema: Schema, selector: ColumnSelector) -> ColumnSelector:
        return super().compute_selector(input_schema, self.selector)


class SubsetColumns(Operator):
    """Some of the columns that reach the node."""

    def __init__(self, names: str | list[str]):
        self.names = [names] if isinstance(names, str) else list(names)

    def compute_selector(self, input_schema: Schema, selector: ColumnSelector) -> ColumnSelector:
        return super().compute_selector(input_schema, ColumnSelector(self.names))


class ConcatColumns(Operator):
    """The columns of several nodes side by side. Of equal names, the last wins and takes its place in the order."""

    label = "+"


class SubtractionOp(Operator):
    """What reaches the node without some columns."""

    label = "-"

    def __init__(self, selector: ColumnSelector | None = None):
        self.selector = selector
        self.gone: list[str] = []

    def set_gone(self, input_schema: Schema, dependencies: Schema | None) -> None:
        by_node = dependencies.column_names if dependencies is not None else []
        by_name = input_schema.select(self.selector).column_names if self.selector else []
        self.gone = [*by_node, *by_name]

    def column_mapping(self, selector: ColumnSelector) -> dict[str, list[str]]:
        return {n: [n] for n in selector.names if n not in self.gone}

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        return {n: columns[n] for n in selector.names if n not in self.gone}


class GroupingOp(Operator):
    """Keeps columns together as a group for the operator that follows."""


class Rename(Operator):
    """New names: by a function f, by a postfix, or one name for a single column; the first that is given holds."""

    def __init__(self, f: Callable[[str], str] | None = None, postfix: str | None = None, name: str | None = None):
        if f is None and postfix is None and name is None:
            raise ValueError("Rename needs f, postfix or name")
        self.f, self.postfix, self.name = f, postfix, name

    def column_mapping(self, selector: ColumnSelector) -> dict[str, list[str]]:
        if self.f is not None:
            new = self.f
        elif self.postfix is not None:
            new = lambda n: n + self.postfix
        else:
            if len(selector.names) != 1:
                raise ValueError("a single name can be given to a single column only")
            new = lambda n: self.name
        return {new(n): [n] for n in selector.names}

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        return {out: columns[of] for out, (of,) in self.column_mapping(selector).items()}


class AddMetadata(Operator):
    """Adds tags and properties; the data stay as they are."""

    def __init__(self, tags: Any = None, properties: dict | None = None):
        self._tags = [tags] if isinstance(tags, str | Tags) else list(tags or [])
        self._properties = dict(properties or {})

    @property
    def output_tags(self) -> list:
        return self._tags

    @property
    def output_properties(self) -> dict:
        return self._properties


class AddTags(AddMetadata):
    def __init__(self, tags: Any = None):
        super().__init__(tags=tags)


class AddProperties(AddMetadata):
    def __init__(self, properties: dict | None = None):
        super().__init__(properties=properties)


def _tagging(name: str, *fixed: Tags) -> type[AddTags]:
    """An operator that adds fixed tags, and those that it is given."""

    def init(self, tags: Any = None):
        AddTags.__init__(self, [*fixed, *([tags] if isinstance(tags, str | Tags) else tags or [])])

    return type(name, (AddTags,), {"__init__": init, "__doc__": f"Adds the tags {', '.join(map(str, fixed))}."})


TagAsUserID = _tagging("TagAsUserID", Tags.ID, Tags.USER)
TagAsItemID = _tagging("TagAsItemID", Tags.ID, Tags.ITEM)
TagAsUserFeatures = _tagging("TagAsUserFeatures", Tags.USER)
TagAsItemFeatures = _tagging("TagAsItemFeatures", Tags.ITEM)


class UDF(Operator):
    """A user's function over each selected column: f(column) or f(column, all columns).

    mode "native": f takes Columns and returns one, and Catalyst knows all of it. mode "pandas": f takes and returns
    pandas Series (and a DataFrame as second argument), in Arrow batches; functions must work row by row, since a batch
    is neither a partition nor the data. mode "arrow": the same with pyarrow arrays. By default native is tried first,
    then pandas. dependency: further columns that f reads, which are neither transformed nor passed on. dtype: of the
    results; where pandas or arrow functions do not give it, a few rows are tried on the driver."""

    SAMPLE = 100

    def __init__(self, f: Callable, dependency: Any = None, label: str | None = None, dtype: Any = None, tags: Any = None, properties: dict | None = None, mode: str = "auto"):
        if f is None:
            raise ValueError("UDF needs a function")
        self.f = f
        self.arity = len(inspect.signature(f).parameters)
        if self.arity not in (1, 2):
            raise ValueError("the function takes a column, or a column and all columns")
        if mode not in ("auto", "native", "pandas", "arrow"):
            raise ValueError(f"no such mode: {mode}")
        self._dependency = [] if dependency is None else [dependency] if not isinstance(dependency, list | tuple) else list(dependency)
        self._label, self._dtype, self.mode = label, None if dtype is None else D.dtype(dtype), mode
        self._tags = [tags] if isinstance(tags, str | Tags) else list(tags or [])
        self._properties = dict(properties or {})
        self._needs: list[str] = []

    @property
    def dependencies(self) -> list:
        return self._dependency

    @property
    def dynamic_dtypes(self) -> bool:  # type: ignore[override]
        return self._dtype is None

    @property
    def output_dtype(self) -> Any:
        return self._dtype

    @property
    def output_tags(self) -> list:
        return self._tags

    @property
    def output_properties(self) -> dict:
        return self._properties

    @property
    def label(self) -> str:
        if self._label:
            return self._label
        name = getattr(self.f, "__name__", "UDF")
        if name != "<lambda>":
            return name
        try:
            return inspect.getsource(self.f).strip()
        except (OSError, TypeError):
            return "UDF"

    def set_needs(self, names: list[str]) -> None:
        self._needs = names

    def column_mapping(self, selector: ColumnSelector) -> dict[str, list[str]]:
        return {n: [n, *(x for x in self._needs if x != n)] for n in selector.names if n not in self._needs or n in selector._names}

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        return {n: self._one(n, selector, columns) for n in self.column_mapping(selector)}

    def _one(self, name: str, selector: ColumnSelector, columns: Columns) -> Column:
        if self.mode in ("auto", "native"):
            try:
                out = self.f(columns[name]) if self.arity == 1 else self.f(columns[name], columns)
                if isinstance(out, Column):
                    columns.base.select(out)  # must be analysed
                    return out.cast(self._dtype.to_spark) if self._dtype is not None and self._dtype.to_spark else out
                problem: Exception | None = TypeError(f"{self.label} returned no Column")
            except (PySparkException, TypeError, AttributeError, ValueError, KeyError) as e:
                problem = e
            if self.mode == "native":
                raise ValueError(f"{self.label} cannot be applied to columns") from problem
        inputs = list(dict.fromkeys([name, *selector.names, *self._needs]))
        kind = self._dtype.to_spark if self._dtype is not None and self._dtype.to_spark else self._sampled(name, inputs, columns)
        return self._batched(name, inputs, columns, kind)

    def _sampled(self, name: str, inputs: list[str], columns: Columns) -> T.DataType:
        rows = columns.only(inputs).frame().limit(self.SAMPLE)
        if self.mode == "arrow":
            from pyspark.sql.pandas.types import from_arrow_type

            table = rows.toArrow().combine_chunks()
            got = self.f(table[name].combine_chunks()) if self.arity == 1 else self.f(table[name].combine_chunks(), table)
            return from_arrow_type(got.type)
        pdf = rows.toPandas()
        got = pd.Series(self.f(pdf[name]) if self.arity == 1 else self.f(pdf[name], pdf)).dropna()
        if len(got) and isinstance(got.iloc[0], list | tuple) and not any(len(x) for x in got):
            got = got.iloc[:0]
        if not len(got) and got.dtype == object:
            raise ValueError(f"the type of {self.label} cannot be told from data; give dtype")
        return rows.sparkSession.createDataFrame(pd.DataFrame({"x": got.reset_index(drop=True)})).schema["x"].dataType if len(got) else D.dtype(got.dtype).to_spark

    def _batched(self, name: str, inputs: list[str], columns: Columns, kind: T.DataType) -> Column:
        f, arity = self.f, self.arity
        if self.mode == "arrow":
            import pyarrow as pa

            if arity == 1:
                return F.arrow_udf(lambda a: f(a), kind)(columns[name])
            at = inputs.index(name)
            whole = lambda *a: f(a[at], pa.table(dict(zip(inputs, a, strict=True))))

            def many(*a: pa.Array) -> pa.Array:
                return whole(*a)

            return F.arrow_udf(many, kind)(*(columns[n] for n in inputs))
        if arity == 1:

            def series(s: pd.Series) -> pd.Series:
                return pd.Series(f(s))

            return F.pandas_udf(series, kind)(columns[name])

        def frame(s: pd.Series, rows: pd.DataFrame) -> pd.Series:
            return pd.Series(f(s, rows))

        return F.pandas_udf(frame, kind)(columns[name], F.struct(*(columns[n].alias(n) for n in inputs)))


class Subgraph(Operator):
    """A named graph inside of a graph. With loop_until, it is repeated until the predicate holds of its output, a
    DataFrame of the whole data; every `checkpoint_every` rounds the lineage is cut in the shared folder of the session.
    most: rounds after which it is an error, if any."""

    def __init__(self, name: str, node: Any, loop_until: Callable[[DataFrame], bool] | None = None, most: int | None = None, checkpoint_every: int = 10):
        from ..plans.graph import Graph

        self.name, self.graph, self.loop_until, self.most, self.checkpoint_every = name, Graph(node), loop_until, most, checkpoint_every

    @property
    def label(self) -> str:
        return self.name

    def compute_selector(self, input_schema: Schema, selector: ColumnSelector) -> ColumnSelector:
        return ColumnSelector(input_schema.column_names)

    def column_mapping(self, selector: ColumnSelector) -> dict[str, list[str]]:
        return self.graph.column_mapping(Schema(selector.names))

    def compute_output_schema(self, input_schema: Schema, selector: ColumnSelector) -> Schema:
        return self.graph.construct_schema(input_schema).output_schema

    @property
    def changes_rows(self) -> bool:
        return self.loop_until is not None or any(n.op is not None and n.op.changes_rows for n in self.graph.nodes)

    def expressions(self, selector: ColumnSelector, columns: Columns) -> dict[str, Column]:
        return dict(self.graph.compile(columns).columns)

    def transform(self, selector: ColumnSelector, df: DataFrame) -> DataFrame:
        from ..functions.frames import cut_lineage

        for i in itertools.count(1):
            df = self.graph.compile(Columns.of(df)).frame()
            if self.loop_until is None:
                return df
            if i % self.checkpoint_every == 0:
                df = cut_lineage(df)
            if self.loop_until(df):
                return df
            if i == self.most:
                raise RuntimeError(f"{self.name} did not end within {self.most} rounds")
