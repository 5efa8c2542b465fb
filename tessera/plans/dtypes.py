"""Semantic element types, and registered mappings between them and the types of other libraries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

import numpy as np
from pyspark.sql import types as T

from .shapes import LIST, SCALAR, Shape


# The names and values of these two enumerations are read by other tools.
class ElementType(Enum):
    Bool = "bool"
    Int = "int"
    UInt = "uint"
    Float = "float"
    String = "string"
    DateTime = "datetime"
    Object = "object"
    Struct = "struct"
    Unknown = "unknown"


class ElementUnit(Enum):
    Year = "Y"
    Month = "M"
    Day = "D"
    Hour = "h"
    Minute = "m"
    Second = "s"
    Millisecond = "ms"
    Microsecond = "us"
    Nanosecond = "ns"


@dataclass(frozen=True)
class DType:
    name: str
    element_type: ElementType = ElementType.Unknown
    element_size: int | None = None
    element_unit: ElementUnit | None = None
    signed: bool | None = None
    shape: Shape = field(default_factory=Shape)

    def to(self, mapping: str) -> Any:
        """The type of a registered mapping."""
        return registry.translate(self, mapping)

    @property
    def to_numpy(self) -> Any:
        return self.to("numpy")

    @property
    def to_python(self) -> Any:
        return self.to("python")

    @property
    def to_spark(self) -> T.DataType | None:
        """The Spark type, an array for lists; None where it is unknown."""
        kind = self.to("spark")
        if kind is None:
            return None
        for _ in range(len(self.shape) - 1 if self.shape.is_list else 0):
            kind = T.ArrayType(kind)
        return kind

    @property
    def is_integer(self) -> bool:
        return self.element_type in (ElementType.Int, ElementType.UInt)

    @property
    def is_float(self) -> bool:
        return self.element_type == ElementType.Float

    @property
    def is_list(self) -> bool:
        return self.shape.is_list

    @property
    def is_ragged(self) -> bool:
        return self.shape.is_ragged

    def with_shape(self, shape: Any) -> DType:
        return replace(self, shape=Shape(shape))

    @property
    def without_shape(self) -> DType:
        return replace(self, shape=Shape())


def _number(kind: ElementType, bits: int) -> DType:
    return DType(f"{kind.value}{bits}", kind, bits, signed=None if kind == ElementType.Float else kind == ElementType.Int)


int8, int16, int32, int64 = (_number(ElementType.Int, n) for n in (8, 16, 32, 64))
uint8, uint16, uint32, uint64 = (_number(ElementType.UInt, n) for n in (8, 16, 32, 64))
float16, float32, float64 = (_number(ElementType.Float, n) for n in (16, 32, 64))
string = DType("str", ElementType.String)
boolean = DType("bool", ElementType.Bool)
object_ = DType("object", ElementType.Object)
struct = DType("struct", ElementType.Struct)
#: Values of any shape, such as JSON has; Spark's own type.
variant = DType("variant", ElementType.Object)
unknown = DType("unknown")
datetime64 = DType("datetime64", ElementType.DateTime, 64)
_dates = {u: DType(f"datetime64[{u.value}]", ElementType.DateTime, 64, u) for u in ElementUnit}
datetime64Y, datetime64M, datetime64D = (_dates[u] for u in (ElementUnit.Year, ElementUnit.Month, ElementUnit.Day))
datetime64h, datetime64m, datetime64s = (_dates[u] for u in (ElementUnit.Hour, ElementUnit.Minute, ElementUnit.Second))
datetime64ms, datetime64us, datetime64ns = (_dates[u] for u in (ElementUnit.Millisecond, ElementUnit.Microsecond, ElementUnit.Nanosecond))

INTS, UINTS, FLOATS, DATES = (int8, int16, int32, int64), (uint8, uint16, uint32, uint64), (float16, float32, float64), (datetime64, *_dates.values())
ALL = (*INTS, *UINTS, *FLOATS, *DATES, string, boolean, object_, struct, variant, unknown)


class Mapping:
    """A table from semantic types to another library's, and back; `seen` reads types that the table does not list."""

    def __init__(self, to_other: dict[DType, Any], from_other: dict | None = None, seen: Callable[[Any], Any] | None = None):
        self.to_other = {k.without_shape: v[0] if isinstance(v, list) else v for k, v in to_other.items()}
        self.from_other: list[tuple[Any, DType]] = [(x, k) for k, v in to_other.items() for x in (v if isinstance(v, list) else [v])]
        self.from_other += list((from_other or {}).items())
        self.seen = seen

    def semantic(self, value: Any) -> DType | None:
        for x in (value, self.seen(value) if self.seen else None):
            if isinstance(x, DType):
                return x
            for other, mine in self.from_other:
                try:
                    if type(other) is type(x) and other == x or other is x:
                        return mine
                except (TypeError, ValueError):
                    continue
        return None

    def other(self, dtype: DType) -> Any:
        if dtype.without_shape not in self.to_other:
            raise ValueError(f"{dtype.name} has no counterpart here")
        return self.to_other[dtype.without_shape]


class Registry:
    def __init__(self) -> None:
        self.mappings: dict[str, Mapping] = {}

    def register(self, names: str | list[str], mapping: Mapping | dict) -> None:
        for name in [names] if isinstance(names, str) else names:
            self.mappings[name] = mapping if isinstance(mapping, Mapping) else Mapping(mapping)

    def translate(self, dtype: DType, name: str) -> Any:
        if name not in self.mappings:
            raise ValueError(f"no mapping is registered as {name!r}; there are {sorted(self.mappings)}")
        return self.mappings[name].other(dtype)

    def semantic(self, value: Any, shape: Any = None) -> DType:
        for mapping in self.mappings.values():
            found = mapping.semantic(value)
            if found is not None:
                return found.with_shape(shape) if shape is not None else found
        return unknown.with_shape(shape) if shape is not None else unknown


registry = Registry()
register = registry.register


def _spark_seen(value: Any) -> Any:
    if isinstance(value, T.ArrayType):
        depth = 1
        while isinstance(value, T.ArrayType):
            value, depth = value.elementType, depth + 1
        inner = registry.mappings["spark"].semantic(value) or unknown
        return inner.with_shape((None,) * depth)
    if isinstance(value, T.StructType):
        return struct
    if isinstance(value, T.VarcharType | T.CharType):
        return string
    return None


def _numpy_seen(value: Any) -> Any:
    if isinstance(value, np.dtype):
        return value if value.kind not in "US" else np.dtype("O")
    if isinstance(value, type) and issubclass(value, np.generic):
        return np.dtype(value)
    return None


_names = {d: [d.name] for d in ALL} | {string: ["str", "string"], boolean: ["bool", "boolean"], struct: ["struct"]}
register("names", Mapping(_names))
register("numpy", Mapping({d: np.dtype(d.name) for d in (*INTS, *UINTS, *FLOATS, *DATES)} | {boolean: np.dtype("bool"), string: np.dtype("O"), object_: np.dtype("O")}, seen=_numpy_seen))
register("python", Mapping({int64: int, float64: float, string: str, boolean: bool} | {d: int for d in (int8, int16, int32, *UINTS)} | {d: float for d in (float16, float32)}))
registry.mappings["python"].from_other = [(int, int64), (float, float64), (str, string), (bool, boolean)]
register("spark", Mapping(
    {int8: T.ByteType(), int16: T.ShortType(), int32: T.IntegerType(), int64: T.LongType(), float32: T.FloatType(), float64: T.DoubleType(),
     string: T.StringType(), boolean: T.BooleanType(), datetime64us: [T.TimestampNTZType(), T.TimestampType()], datetime64D: T.DateType(), variant: T.VariantType()},
    seen=_spark_seen,
))
# types that Spark does not have: the next wider one; nothing is said of structs and unknown types
registry.mappings["spark"].to_other |= {uint8: T.ShortType(), uint16: T.IntegerType(), uint32: T.LongType(), uint64: T.DecimalType(20, 0), float16: T.FloatType(), object_: T.StringType(), struct: None, unknown: None}
registry.mappings["spark"].to_other |= {d: T.TimestampNTZType() for d in DATES if d != datetime64D} | {datetime64Y: T.DateType(), datetime64M: T.DateType()}
try:
    import pandas as pd

    _nullable = {int8: pd.Int8Dtype(), int16: pd.Int16Dtype(), int32: pd.Int32Dtype(), int64: pd.Int64Dtype(), uint8: pd.UInt8Dtype(), uint16: pd.UInt16Dtype(), uint32: pd.UInt32Dtype(), uint64: pd.UInt64Dtype(), float32: pd.Float32Dtype(), float64: pd.Float64Dtype(), string: pd.StringDtype(), boolean: pd.BooleanDtype()}
    register("pandas", Mapping(_nullable, seen=lambda v: dtype(v.categories.dtype) if isinstance(v, pd.CategoricalDtype) else None))
except ImportError:  # pragma: no cover
    pass


def dtype(value: Any, shape: Any = None) -> DType:
    """The semantic type of a name or of another library's type; unknown if none is registered for it."""
    if value is None:
        raise TypeError("None is not a type")
    if isinstance(value, DType):
        return value.with_shape(shape) if shape is not None else value
    found = registry.semantic(value, shape)
    if found.element_type == ElementType.Unknown and not isinstance(value, T.DataType) and value != "unknown":
        try:
            return registry.semantic(np.dtype(value), shape)
        except TypeError:
            pass
    return found


__all__ = ["ALL", "LIST", "SCALAR", "DType", "ElementType", "ElementUnit", "Mapping", "dtype", "register", "registry", *(d.name for d in (*INTS, *UINTS, *FLOATS))]
