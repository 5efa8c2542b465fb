"""Column schemas with meaning, their algebra, and the bridge to Spark's StructType.

The meaning of a column travels with Spark columns as one JSON string in the field's metadata."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from . import dtypes as D
from .selector import ColumnSelector
from .shapes import Dimension, Shape
from .tags import Tags, TagSet, atoms, normalise

META = "tessera"


@dataclass(frozen=True)
class Domain:
    """Range of a column's values."""

    min: int | float | None = None
    max: int | float | None = None
    name: str | None = None

    @property
    def is_bounded(self) -> bool:
        return self.min is not None and self.max is not None


class ColumnSchema:
    """Name, type, shape, tags and properties of a column. The shape comes from the first of: dims, the type's shape, the
    property value_count, is_list and is_ragged; contradictions raise."""

    def __init__(self, name: str, tags: Any = None, properties: dict | None = None, dtype: Any = None, is_list: bool | None = None, is_ragged: bool | None = None, dims: Any = None):
        self.name = name
        self.tags = TagSet(tags)
        self.properties = dict(properties or {})
        kind = D.unknown if dtype is None else D.dtype(dtype)
        count = self.properties.get("value_count")
        if is_ragged and is_list is False:
            raise ValueError(f"{name} cannot be ragged without being a list")
        if dims is not None:
            shape = Shape(dims)
        elif not kind.shape.is_unknown:
            shape = kind.shape
        elif count:
            low, high = count.get("min"), count.get("max")
            if is_ragged is False:
                low, high = (high if low in (None, 0) else low), (low if high is None else high)
                if low != high:
                    raise ValueError(f"{name} is not ragged, but its lists have {low} to {high} values")
            shape = Shape((None, (low or 0, high)))
        elif is_list or is_ragged:
            shape = D.LIST
        elif is_list is False:
            shape = D.SCALAR
        else:
            shape = Shape()
        if not shape.is_unknown:
            if is_list is not None and is_list != shape.is_list:
                raise ValueError(f"{name}: is_list={is_list} contradicts {shape}")
            if is_ragged is not None and shape.is_list and is_ragged != shape.is_ragged:
                raise ValueError(f"{name}: is_ragged={is_ragged} contradicts {shape}")
        self.shape = shape
        self.dtype = kind.with_shape(shape.dims)
        if shape.is_list:
            d = shape[1]
            self.properties["value_count"] = {"min": d.min} | ({"max": d.max} if d.is_bounded else {})
        else:
            self.properties.pop("value_count", None)

    # what follows from the above
    @property
    def is_list(self) -> bool:
        return self.shape.is_list

    @property
    def is_ragged(self) -> bool:
        return self.shape.is_ragged

    @property
    def value_count(self) -> Dimension | None:
        return self.shape[1] if self.is_list else None

    @property
    def domain(self) -> Domain | None:
        d = self.properties.get("domain")
        return Domain(d.get("min"), d.get("max"), d.get("name")) if d else None

    @property
    def int_domain(self) -> Domain | None:
        return self.domain if self.dtype.is_integer else None

    @property
    def float_domain(self) -> Domain | None:
        return self.domain if self.dtype.is_float else None

    # changed copies
    def _copy(self, **changes: Any) -> ColumnSchema:
        kept = {"name": self.name, "tags": self.tags, "properties": self.properties, "dtype": self.dtype.without_shape, "dims": self.shape.dims} | changes
        return ColumnSchema(**kept)

    def with_name(self, name: str) -> ColumnSchema:
        return self._copy(name=name)

    def with_tags(self, tags: Any) -> ColumnSchema:
        return self._copy(tags=self.tags.override(tags))

    def with_properties(self, properties: dict) -> ColumnSchema:
        dims = None if properties.get("value_count") else self.shape.dims
        return self._copy(properties=self.properties | properties, dims=dims)

    def with_dtype(self, dtype: Any, is_list: bool | None = None, is_ragged: bool | None = None) -> ColumnSchema:
        kind = D.unknown if dtype is None else D.dtype(dtype)
        if is_list is None and is_ragged is None:
            return self._copy(dtype=kind.without_shape, dims=self.shape.dims if kind.shape.is_unknown else kind.shape.dims)
        rest = {k: v for k, v in self.properties.items() if k != "value_count"}
        return self._copy(dtype=kind.without_shape, properties=rest, dims=None, is_list=is_list, is_ragged=is_ragged)

    def with_shape(self, shape: Any) -> ColumnSchema:
        rest = {k: v for k, v in self.properties.items() if k != "value_count"}
        return self._copy(properties=rest, dims=Shape(shape).dims)

    def merged(self, other: ColumnSchema) -> ColumnSchema:
        """The other's name, type, properties and shape go before; tags are put together."""
        kind = other.dtype if other.dtype.element_type != D.ElementType.Unknown else self.dtype
        dims = other.shape.dims if not other.shape.is_unknown else self.shape.dims
        rest = {k: v for k, v in (self.properties | other.properties).items() if k != "value_count"}
        return ColumnSchema(other.name, self.tags.override(other.tags), rest, kind.without_shape, dims=dims)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ColumnSchema) and (self.name, self.tags, self.properties, self.dtype, self.shape) == (other.name, other.tags, other.properties, other.dtype, other.shape)

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        return f"ColumnSchema({self.name!r}, {self.dtype.name}, {self.shape}, {self.tags}, {self.properties})"

    # Spark
    def to_meta(self) -> dict:
        return {"dtype": self.dtype.name, "dims": self.shape.as_tuple, "tags": [str(t) for t in self.tags], "properties": self.properties}

    def metadata(self) -> dict[str, str]:
        """Field metadata."""
        return {META: json.dumps(self.to_meta(), sort_keys=True, default=str)}

    @classmethod
    def from_field(cls, field: T.StructField) -> ColumnSchema:
        kind = D.dtype(field.dataType)
        if kind.shape.is_unknown:
            kind = kind.with_shape(D.SCALAR)
        if META not in (field.metadata or {}):
            return cls(field.name, dtype=kind)
        m = json.loads(field.metadata[META])
        dims = m["dims"] and [tuple(d) if isinstance(d, list) else d for d in m["dims"]]
        named = D.dtype(m["dtype"])
        known = named.element_type != D.ElementType.Unknown
        same_depth = dims is not None and len(dims) == len(kind.shape)
        return cls(field.name, m["tags"], m["properties"] if same_depth else {k: v for k, v in m["properties"].items() if k != "value_count"}, (named if known else kind).without_shape, dims=dims if same_depth else kind.shape.dims)


class Schema:
    """An ordered set of column schemas."""

    def __init__(self, columns: Any = None):
        if isinstance(columns, dict):
            columns = columns.values()
        self.column_schemas: dict[str, ColumnSchema] = {}
        for c in columns or []:
            c = c if isinstance(c, ColumnSchema) else ColumnSchema(c)
            self.column_schemas[c.name] = c

    @property
    def column_names(self) -> list[str]:
        return list(self.column_schemas)

    # selection
    def select(self, selector: Any) -> Schema:
        """Columns by selector, names or "*"; names come first, then tags; unknown names are left out."""
        if selector is None:
            return self
        selector = selector if isinstance(selector, ColumnSelector) else ColumnSelector(selector)
        if selector.all:
            return self
        return Schema(self.column_schemas[n] for n in selector.resolve(self).names)

    apply = select

    def excluding(self, selector: Any) -> Schema:
        if selector is None:
            return self
        gone = set(self.select(selector).column_names)
        return Schema(c for n, c in self.column_schemas.items() if n not in gone)

    apply_inverse = excluding

    def select_by_name(self, names: str | Iterable[str]) -> Schema:
        return Schema(self.column_schemas[n] for n in ([names] if isinstance(names, str) else names) if n in self.column_schemas)

    def excluding_by_name(self, names: str | Iterable[str]) -> Schema:
        gone = {names} if isinstance(names, str) else set(names)
        return Schema(c for n, c in self.column_schemas.items() if n not in gone)

    def _tagged(self, tags: Any, pred: Callable[[Iterable[bool]], bool] | None) -> set[str]:
        given = [tags] if isinstance(tags, str | Tags) else list(tags)
        want = atoms(given)
        if pred is None:  # a single compound asks for all of what it stands for
            pred = all if len(given) == 1 and len(want) > 1 else any
        return {n for n, c in self.column_schemas.items() if want and pred(normalise(t) in c.tags.tags for t in want)}

    def select_by_tag(self, tags: Any, pred_fn: Callable | None = None) -> Schema:
        found = self._tagged(tags, pred_fn)
        return Schema(c for n, c in self.column_schemas.items() if n in found)

    def excluding_by_tag(self, tags: Any, pred_fn: Callable | None = None) -> Schema:
        found = self._tagged(tags, pred_fn)
        return Schema(c for n, c in self.column_schemas.items() if n not in found)

    remove_by_tag = excluding_by_tag

    # access
    def get(self, name: str, default: Any = None) -> Any:
        return self.column_schemas.get(name, default)

    @property
    def first(self) -> ColumnSchema:
        return next(iter(self.column_schemas.values()))

    def remove_col(self, name: str) -> Schema:
        return self.excluding_by_name(name)

    def without(self, names: str | Iterable[str]) -> Schema:
        return self.excluding_by_name(names)

    def copy(self) -> Schema:
        return Schema(self)

    def __getitem__(self, names: str | list[str]) -> Any:
        if isinstance(names, str):
            return self.column_schemas[names]
        return Schema(self.column_schemas[n] for n in names)

    def __setitem__(self, name: str, column: ColumnSchema) -> None:
        self.column_schemas[name] = column.with_name(name)

    def __iter__(self) -> Iterator[ColumnSchema]:
        return iter(self.column_schemas.values())

    def __len__(self) -> int:
        return len(self.column_schemas)

    def __contains__(self, name: str) -> bool:
        return name in self.column_schemas

    # algebra
    def __add__(self, other: Any) -> Schema:
        """Columns only here first, then all of the other's, which win where both have one."""
        if other is None:
            return self
        if not isinstance(other, Schema):
            return NotImplemented
        both = [self.column_schemas[n].merged(c) if n in self.column_schemas else c for n, c in other.column_schemas.items()]
        return Schema([*(c for n, c in self.column_schemas.items() if n not in other.column_schemas), *both])

    def __radd__(self, other: Any) -> Schema:
        return self if other is None or other == 0 else NotImplemented

    def __sub__(self, other: Any) -> Schema:
        if other is None:
            return self
        if not isinstance(other, Schema):
            return NotImplemented
        return self.excluding_by_name(other.column_names)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and list(self.column_schemas.items()) == list(other.column_schemas.items())

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        return f"Schema({list(self)})"

    # bridges
    def rows(self) -> list[dict]:
        """One dict per column, with tags and properties as text."""
        return [{"name": c.name, "tags": json.dumps([str(t) for t in c.tags]), "dtype": c.dtype.name, "is_list": c.is_list, "is_ragged": c.is_ragged, "properties": json.dumps(c.properties, sort_keys=True, default=str)} for c in self]

    def to_pandas(self):
        import pandas as pd

        return pd.DataFrame([{"name": c.name, "tags": list(c.tags), "dtype": c.dtype.name, "is_list": c.is_list, "is_ragged": c.is_ragged} | {f"properties.{k}": v for k, v in c.properties.items()} for c in self])

    def to_spark_frame(self, spark):
        return spark.createDataFrame(self.rows() or [], "name string, tags string, dtype string, is_list boolean, is_ragged boolean, properties string")

    @classmethod
    def from_spark(cls, struct: T.StructType) -> Schema:
        return cls(ColumnSchema.from_field(f) for f in struct.fields)

    def to_spark(self) -> T.StructType:
        """Types of which Spark knows nothing are strings."""
        return T.StructType([T.StructField(c.name, c.dtype.to_spark or T.StringType(), True, c.metadata()) for c in self])
