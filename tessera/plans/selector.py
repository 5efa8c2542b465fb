"""Selections of columns by name, tag, group or wildcard."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from .tags import Tags, atoms

if TYPE_CHECKING:
    from .schema import Schema


class ColumnSelector:
    """names: column names; lists among them are groups of columns that belong together, one level deep. tags: columns
    that carry any of them. "*" selects everything."""

    def __init__(self, names: Any = None, subgroups: Any = None, tags: Any = None):
        self.all = False
        self._names: list[str] = []
        self.subgroups: list[ColumnSelector] = []
        for x in [names] if isinstance(names, str | ColumnSelector) else names or []:
            self._take(x)
        for x in [subgroups] if isinstance(subgroups, ColumnSelector | str) else subgroups or []:
            self._group(x)
        self.tags: list = [tags] if isinstance(tags, str | Tags) else list(tags or [])
        if self.all:
            self._names, self.subgroups, self.tags = [], [], []

    def _take(self, x: Any) -> None:
        if isinstance(x, str):
            if x == "*":
                self.all = True
            elif x not in self._names:
                self._names.append(x)
        elif isinstance(x, ColumnSelector):
            self.all = self.all or x.all
            for n in x._names:
                self._take(n)
            self.subgroups += [g for g in x.subgroups if g not in self.subgroups]
        elif isinstance(x, list | tuple | set):
            self._group(list(x))
        else:
            raise TypeError(f"columns are selected by names, not by {type(x).__name__}")

    def _group(self, x: Any) -> None:
        group = x if isinstance(x, ColumnSelector) else ColumnSelector(x)
        if group.subgroups:
            raise ValueError("groups of columns cannot hold groups")
        if group not in self.subgroups:
            self.subgroups.append(group)

    @property
    def names(self) -> list[str]:
        """All names, those in groups too, once."""
        return list(dict.fromkeys([*self._names, *(n for g in self.subgroups for n in g._names)]))

    @property
    def grouped_names(self) -> list:
        """Names, and tuples of the names of groups."""
        return [*self._names, *(tuple(g._names) for g in self.subgroups)]

    def resolve(self, schema: Schema) -> ColumnSelector:
        """Only names, of columns that the schema has."""
        if self.all:
            return ColumnSelector(schema.column_names)
        tagged = schema.select_by_tag(self.tags).column_names if self.tags else []
        names = [n for n in self._names if n in schema.column_names]
        groups = [[n for n in g._names if n in schema.column_names] for g in self.subgroups]
        grouped = {n for g in groups for n in g}
        return ColumnSelector([*names, *(n for n in tagged if n not in grouped)], subgroups=[g for g in groups if g])

    def filter_columns(self, other: ColumnSelector) -> ColumnSelector:
        """Without the names of another selector."""
        drop = set(other.names)
        groups = [[n for n in g._names if n not in drop] for g in self.subgroups]
        out = ColumnSelector([n for n in self._names if n not in drop], subgroups=[g for g in groups if g], tags=self.tags)
        out.all = self.all
        return out

    def __add__(self, other: Any) -> Any:
        from .node import Node

        if other is None:
            return self
        if isinstance(other, Node):
            return Node.of(self) + other
        other = other if isinstance(other, ColumnSelector) else ColumnSelector(tags=[other]) if isinstance(other, Tags) else ColumnSelector(other)
        if self.all or other.all:
            return ColumnSelector("*")
        return ColumnSelector([*self._names, *other._names], subgroups=[*self.subgroups, *other.subgroups], tags=[*self.tags, *other.tags])

    def __radd__(self, other: Any) -> Any:
        return (other if isinstance(other, ColumnSelector) else ColumnSelector(other)) + self

    def __rshift__(self, operator: Any) -> Any:
        from .node import Node

        return Node.of(self) >> operator

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, ColumnSelector):
            return NotImplemented
        return (self.all, self._names, self.subgroups, atoms(self.tags)) == (other.all, other._names, other.subgroups, atoms(other.tags))

    def __bool__(self) -> bool:
        return self.all or bool(self._names or self.subgroups or self.tags)

    def __repr__(self) -> str:
        return "ColumnSelector('*')" if self.all else f"ColumnSelector({self.grouped_names}, tags={[str(t) for t in self.tags]})"

    __hash__ = None  # type: ignore[assignment]
