"""Nodes: how a graph of operators is written down."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from ..operators.base import Columns, Operator
from ..operators.columns import UDF, ConcatColumns, GroupingOp, SelectionOp, SubsetColumns, SubtractionOp
from .schema import Schema
from .selector import ColumnSelector


class Node:
    """An operator, the nodes whose columns it gets (parents), and those that it reads besides (dependencies). A node
    without operator takes columns from the root."""

    def __init__(self, selector: Any = None):
        self.selector: ColumnSelector | None = selector if isinstance(selector, ColumnSelector) or selector is None else ColumnSelector(selector)
        self.op: Operator | None = None
        self.parents: list[Node] = []
        self.dependencies: list[Node] = []
        self.children: list[Node] = []
        self.input_schema: Schema | None = None
        self.output_schema: Schema | None = None
        self.resolved: ColumnSelector | None = None

    # writing
    @classmethod
    def of(cls, x: Any) -> Node:
        """A node of a name, list, selector, schema or operator; of a list with nodes, one that joins them."""
        if isinstance(x, Node):
            return x
        if isinstance(x, Schema):
            x = ColumnSelector(x.column_names)
        if isinstance(x, ColumnSelector):
            return cls(x)
        if isinstance(x, str):
            return cls(ColumnSelector(x))
        if isinstance(x, list | tuple):
            if any(isinstance(y, Node) for y in x):
                nodes = [cls.of(y) for y in x if isinstance(y, Node)]
                names = [y for y in x if not isinstance(y, Node)]
                return cls._made(GroupingOp(), [*([cls(ColumnSelector(names))] if names else []), *nodes])
            return cls(ColumnSelector(list(x)))
        raise TypeError(f"no node can be made of {type(x).__name__}")

    @classmethod
    def construct_from(cls, x: Any) -> Node:
        return cls.of(x)

    @classmethod
    def _made(cls, op: Operator, parents: list[Node], dependencies: list[Node] | None = None) -> Node:
        node = cls()
        node.op = op
        for p in parents:
            node.add_parent(p)
        for d in dependencies or []:
            node.add_dependency(d)
        return node

    def add_parent(self, x: Any) -> None:
        node = Node.of(x)
        self.parents.append(node)
        node.children.append(self)

    def add_dependency(self, x: Any) -> None:
        node = Node.of(x)
        self.dependencies.append(node)
        node.children.append(self)

    def add_child(self, x: Any) -> None:
        Node.of(x).add_parent(self)

    def __rshift__(self, operator: Any) -> Node:
        if isinstance(operator, type) and issubclass(operator, Operator):
            operator = operator()
        if not isinstance(operator, Operator):
            if not callable(operator):
                raise TypeError(f"columns go into an operator or a function, not into {type(operator).__name__}")
            operator = UDF(operator)
        needs = operator.dependencies
        nodes = [x for x in needs if isinstance(x, Node)]
        names = [x for x in needs if not isinstance(x, Node)]
        return Node._made(operator, [self], [*([Node(ColumnSelector(names))] if names else []), *nodes])

    def _joined(self, other: Any, first: bool) -> Node:
        if other is None:
            return self
        other = Node.of(other)
        # a chain of additions is one node
        mine = self.parents if isinstance(self.op, ConcatColumns) else [self]
        theirs = other.parents if isinstance(other.op, ConcatColumns) else [other]
        return Node._made(ConcatColumns(), [*mine, *theirs] if first else [*theirs, *mine])

    def __add__(self, other: Any) -> Node:
        return self._joined(other, True)

    def __radd__(self, other: Any) -> Node:
        return self._joined(other, False)

    def __sub__(self, other: Any) -> Node:
        parts = other if isinstance(other, list | tuple) else [other]
        nodes = [x for x in parts if isinstance(x, Node)]
        plain = [n for n in nodes if n.op is None]
        made = [n for n in nodes if n.op is not None]
        selector = ColumnSelector([])
        for x in [*(n.selector for n in plain), *(y for y in parts if not isinstance(y, Node))]:
            selector = selector + x
        return Node._made(SubtractionOp(selector or None), [self], made)

    def __rsub__(self, other: Any) -> Node:
        return Node.of(other) - self

    def __getitem__(self, names: str | list[str]) -> Node:
        return Node._made(SubsetColumns(names), [self])

    # walking
    def _walk(self, seen: set[int], before: bool) -> Iterator[Node]:
        if id(self) in seen:
            return
        seen.add(id(self))
        if before:
            yield self
        for n in [*self.parents, *self.dependencies]:
            yield from n._walk(seen, before)
        if not before:
            yield self

    def post_order(self) -> list[Node]:
        """This node and all above it, each after what it needs."""
        return list(self._walk(set(), False))

    def pre_order(self) -> list[Node]:
        return list(self._walk(set(), True))

    # analysis
    @property
    def parents_with_dependencies(self) -> list[Node]:
        return [*self.parents, *self.dependencies]

    @property
    def label(self) -> str:
        return self.op.label if self.op else f"input {self.selector.grouped_names if not self.selector.all else '*'}"

    def groups(self) -> list[list[str]]:
        """Groups of columns that reach this node's operator."""
        out = []
        for p in self.parents:
            if p.op is None and p.selector is not None:
                out += [g._names for g in p.selector.subgroups]
            elif isinstance(p.op, GroupingOp) and p.output_schema is not None:
                out.append(p.output_schema.column_names)
        return out

    def compute_schemas(self, root: Schema) -> None:
        if self.op is None:
            op = SelectionOp(self.selector)
            self.input_schema = root
            self.resolved = op.compute_selector(root, self.selector)
            self.output_schema = op.compute_output_schema(root, self.resolved)
            return
        have = Schema()
        for p in self.parents:
            have = have + p.output_schema
        needs = None
        for d in self.dependencies:
            needs = (needs or Schema()) + d.output_schema
        selector = ColumnSelector(have.column_names)
        if groups := self.groups():
            grouped = {n for g in groups for n in g}
            selector = ColumnSelector([n for n in have.column_names if n not in grouped], subgroups=groups)
        if isinstance(self.op, SubtractionOp):
            self.op.set_gone(have, needs)
            self.input_schema = have
        else:
            self.input_schema = (needs or Schema()) + have  # what comes from the parents goes before
        if isinstance(self.op, UDF):
            self.op.set_needs(needs.column_names if needs is not None else [])
        self.resolved = self.op.compute_selector(self.input_schema, selector)
        self.output_schema = self.op.compute_output_schema(self.input_schema, self.resolved)

    def validate_schemas(self, root: Schema, strict_dtypes: bool = False) -> None:
        """Raises if a column that a root selection needs is missing, or, if strict, has another type than was planned."""
        if self.op is None:
            for c in self.output_schema:
                if c.name not in root:
                    raise ValueError(f"Missing column {c.name!r} in the data; there are {root.column_names}")
                if strict_dtypes and c.dtype.without_shape != root[c.name].dtype.without_shape:
                    raise ValueError(f"column {c.name!r} is {root[c.name].dtype.name}, not {c.dtype.name} as planned")

    @property
    def column_mapping(self) -> dict[str, list[str]]:
        if self.op is None:
            return {n: [n] for n in self.output_schema.column_names}
        return self.op.column_mapping(self.resolved)

    # compilation
    def compile(self, root: Columns, done: dict[int, Columns]) -> Columns:
        """The node's columns over the root's DataFrame, or over that of an operator that changes rows."""
        if id(self) in done:
            return done[id(self)]
        if self.op is None:
            out = root.only([n for n in self.output_schema.column_names if n in root])
        else:
            parents = [p.compile(root, done) for p in self.parents]
            # what a subtraction takes away by node is known by name already
            needs = [] if isinstance(self.op, SubtractionOp) else [d.compile(root, done) for d in self.dependencies]
            have = _side_by_side([*needs, *parents], self.label)
            mapping = self.op.column_mapping(self.resolved)
            able = {n for n, made_of in mapping.items() if all(x in have for x in made_of)}
            selector = self.resolved
            if len(able) < len(mapping):  # inputs were removed, and what is made of them goes too
                lost = [n for n in selector.names if n not in have]
                selector = selector.filter_columns(ColumnSelector(lost))
            if not able:
                out = Columns(have.base, {})
            elif self.op.changes_rows:
                df = self.op.transform(selector, have.frame())
                out = Columns.of(df).only([n for n in self.output_schema.column_names if n in df.columns])
            else:
                made = self.op.expressions(selector, have)
                out = Columns(have.base, {n: made[n] for n in self.output_schema.column_names if n in made and n in able})
        done[id(self)] = out
        return out

    def __repr__(self) -> str:
        return f"<Node {self.label}>"


def _side_by_side(parts: list[Columns], label: str) -> Columns:
    """Columns of several nodes; of equal names the last wins and moves to its place."""
    bases = {id(p.base): p.base for p in parts if len(p)}
    if len(bases) > 1:
        raise ValueError(f"{label} cannot put columns side by side whose rows were changed by different operators; join them instead")
    columns: dict = {}
    for p in parts:
        columns = {n: c for n, c in columns.items() if n not in p} | p.columns
    return Columns(next(iter(bases.values())) if bases else parts[0].base, columns)


def iter_nodes(nodes: Node | list[Node]) -> Iterator[Node]:
    seen: set[int] = set()
    for n in nodes if isinstance(nodes, list) else [nodes]:
        yield from n._walk(seen, True)


def preorder_iter_nodes(nodes: Node | list[Node]) -> Iterator[Node]:
    yield from iter_nodes(nodes)


def postorder_iter_nodes(nodes: Node | list[Node]) -> Iterator[Node]:
    seen: set[int] = set()
    for n in nodes if isinstance(nodes, list) else [nodes]:
        yield from n._walk(seen, False)


def nodify(x: Any) -> Node:
    return Node.of(x)


Function = Callable
