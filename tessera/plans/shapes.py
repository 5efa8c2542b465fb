"""Shapes of columns: rows first, then the lengths of (nested) lists, each with bounds."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Dimension:
    """Bounds of a length; max None means unbounded."""

    min: int = 0
    max: int | None = None

    def __post_init__(self) -> None:
        if self.min is None:
            raise ValueError("a dimension needs a minimum; use 0")
        for x in (self.min, self.max):
            if x is not None and (isinstance(x, bool) or not isinstance(x, int)):
                raise ValueError(f"bounds are integers, not {x!r}")
        if self.min < 0 or (self.max is not None and self.max < 0):
            raise ValueError("bounds cannot be negative")
        if self.max is not None and self.max < self.min:
            raise ValueError(f"the maximum {self.max} is below the minimum {self.min}")

    @property
    def is_bounded(self) -> bool:
        return self.max is not None

    @property
    def is_fixed(self) -> bool:
        return self.is_bounded and self.min == self.max

    @property
    def is_variable(self) -> bool:
        return not self.is_fixed

    @property
    def is_uniform(self) -> bool:
        return self.is_fixed

    @property
    def is_unknown(self) -> bool:
        return self.min == 0 and self.max is None

    def __int__(self) -> int:
        if not self.is_fixed:
            raise ValueError("only a fixed dimension is a number")
        return self.min

    def as_tuple(self) -> tuple[int, int | None]:
        return self.min, self.max


def _dimension(x: Any) -> Dimension:
    if isinstance(x, Dimension):
        return x
    if x is None:
        return Dimension()
    if isinstance(x, int):
        return Dimension(x, x)
    if isinstance(x, tuple | list) and len(x) == 2:
        return Dimension(*x)
    raise ValueError(f"not a dimension: {x!r}")


class Shape:
    """dims: None for an unknown shape, which equals every shape; otherwise None (any length), n, or (low, high) each."""

    __slots__ = ("dims",)

    def __init__(self, dims: Any = None):
        if isinstance(dims, Shape):
            dims = dims.dims
        self.dims: tuple[Dimension, ...] | None = None if dims is None else tuple(_dimension(x) for x in dims)

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Shape):
            try:
                other = Shape(other)
            except (TypeError, ValueError):
                return NotImplemented
        return self.dims is None or other.dims is None or self.dims == other.dims

    def __hash__(self) -> int:
        return 0  # unknown shapes equal all others

    def __iter__(self):
        return iter(self.dims or ())

    def __len__(self) -> int:
        return len(self.dims or ())

    def __getitem__(self, i: int) -> Dimension:
        return (self.dims or ())[i]

    def __repr__(self) -> str:
        return f"Shape({None if self.dims is None else self.as_tuple})"

    @property
    def is_unknown(self) -> bool:
        return self.dims is None

    @property
    def is_list(self) -> bool:
        return self.dims is not None and len(self.dims) > 1

    @property
    def is_ragged(self) -> bool:
        return self.is_list and any(d.is_variable for d in self.dims[1:])

    @property
    def as_tuple(self) -> tuple | None:
        """The form in which shapes are stored: n for fixed, None for any, else (low, high)."""
        if self.dims is None:
            return None
        return tuple(None if d.is_unknown else d.min if d.is_fixed else d.as_tuple() for d in self.dims)


SCALAR = Shape((None,))
LIST = Shape((None, None))
