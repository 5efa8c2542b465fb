"""Graphs of operators, compiled to one lazy DataFrame; fitting in phases."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from ..operators.base import Columns, Operator, StatOperator
from ..operators.columns import Subgraph
from .node import Node
from .schema import ColumnSchema, Schema
from .selector import ColumnSelector


class Graph:
    """The graph that ends in a node."""

    def __init__(self, output_node: Any):
        self.output_node = Node.of(output_node)
        self.removed: set[str] = set()
        self.subgraphs: dict[str, Graph] = {}
        for n in self.nodes:
            if isinstance(n.op, Subgraph):
                if n.op.name in self.subgraphs:
                    raise ValueError(f"there are two subgraphs called {n.op.name!r}")
                self.subgraphs[n.op.name] = n.op.graph
            if n.op is not None:
                n.op.load_artifacts(None)

    @property
    def nodes(self) -> list[Node]:
        return self.output_node.post_order()

    @property
    def leaf_nodes(self) -> list[Node]:
        return [n for n in self.nodes if n.op is None]

    def subgraph(self, name: str) -> Graph:
        if name not in self.subgraphs:
            raise ValueError(f"there is no subgraph {name!r}")
        return self.subgraphs[name]

    def get_nodes_by_op_type(self, kind: type[Operator]) -> list[Node]:
        return [n for n in self.nodes if isinstance(n.op, kind)]

    # schemas
    def construct_schema(self, root: Schema, preserve_dtypes: bool = False) -> Graph:
        """Works out the schemas of all nodes. preserve_dtypes: types that data have shown are kept."""
        before = {id(n): n.output_schema for n in self.nodes}
        for n in self.nodes:
            n.compute_schemas(root)
            old = before[id(n)]
            if preserve_dtypes and old is not None:
                n.output_schema = Schema(c.with_dtype(old[c.name].dtype) if c.name in old and c.dtype.name == "unknown" else c for c in n.output_schema)
            n.validate_schemas(root)
        return self

    @property
    def input_schema(self) -> Schema:
        """The root columns that the graph reads."""
        out = Schema()
        for n in self.leaf_nodes:
            out = out + n.output_schema
        return Schema(c for c in out if c.name not in self.removed)

    @property
    def output_schema(self) -> Schema:
        made_of = self.column_mapping() if self.removed else {}
        return Schema(c for c in self.output_node.output_schema if not self.removed.intersection(made_of.get(c.name, ())))

    def column_mapping(self, root: Schema | None = None) -> dict[str, list[str]]:
        """Output columns to the root columns that they are made of."""
        if root is not None:
            self.construct_schema(root)
        lineage: dict[int, dict[str, list[str]]] = {}
        for n in self.nodes:
            if n.op is None:
                lineage[id(n)] = {c: [c] for c in n.output_schema.column_names}
                continue
            above: dict[str, list[str]] = {}
            for p in [*n.dependencies, *n.parents]:
                above |= lineage[id(p)]
            lineage[id(n)] = {out: list(dict.fromkeys(x for i in made_of for x in above.get(i, [i]))) for out, made_of in n.column_mapping.items()}
        return lineage[id(self.output_node)]

    def remove_inputs(self, names: list[str]) -> Graph:
        """The same graph without some root columns and all that is made of them."""
        out = Graph(self.output_node)
        out.removed = self.removed | set(names)
        return out

    # execution
    def compile(self, root: Columns) -> Columns:
        schema = Schema.from_spark(root.frame().schema)
        missing = [n for n in self.removed if n not in schema]
        self.construct_schema(Schema([*schema, *(ColumnSchema(n) for n in missing)]), preserve_dtypes=True)
        return self.output_node.compile(root.only([n for n in root if n not in self.removed]), {})

    def transform(self, data: Any) -> Any:
        """Applies the graph to a DataFrame or a Dataset, lazily, as one projection where no operator changes rows."""
        from ..sources.dataset import Dataset

        df = data.to_df() if isinstance(data, Dataset) else data
        unfitted = [n.label for n in self.nodes if isinstance(n.op, StatOperator) and not n.op.fitted]
        if unfitted:
            raise RuntimeError(f"{', '.join(unfitted)} must be fitted before it transforms")
        out = self.compile(Columns.of(df))
        planned = {c.name: c for c in self.output_schema}
        frame = out.frame()
        told = {f.name: ColumnSchema.from_field(f) for f in frame.schema.fields}
        final = []
        for n, c in out.columns.items():
            s = planned[n]
            if s.dtype.element_type.value == "unknown" or s.shape.is_list != told[n].shape.is_list:
                rest = {k: v for k, v in s.properties.items() if k != "value_count"}
                s = ColumnSchema(n, s.tags, rest, told[n].dtype.without_shape, dims=told[n].shape.dims)
            final.append(c.alias(n, metadata=s.metadata()))
        result = out.base.select(*final)
        for node in self.nodes:
            if node is self.output_node:
                node.output_schema = Schema.from_spark(result.schema)
        return Dataset(result) if isinstance(data, Dataset) else result

    def fit(self, data: Any, refit: bool = True) -> Graph:
        """Fits operators in phases: those that need no unfitted one together, in one job for all their aggregates."""
        from ..sources.dataset import Dataset

        df = data.to_df() if isinstance(data, Dataset) else data
        if refit:
            self.clear_stats()
        for g in self.subgraphs.values():
            inner = [n for n in g.nodes if isinstance(n.op, StatOperator)]
            if inner:
                outer = next(n for n in self.nodes if isinstance(n.op, Subgraph) and n.op.graph is g)
                self._fit_above(outer, df)
                root = Columns.of(df)
                self.construct_schema(Schema.from_spark(df.schema))
                inputs = [p.compile(root, {}) for p in outer.parents]
                g.fit(Columns(inputs[0].base, {n: c for x in inputs for n, c in x.columns.items()}).frame(), refit)
        self._fit_nodes(self.nodes, df)
        return self

    def _fit_above(self, node: Node, df: DataFrame) -> None:
        self._fit_nodes([n for n in node.post_order() if n is not node], df)

    def _fit_nodes(self, nodes: list[Node], df: DataFrame) -> None:
        self.construct_schema(Schema.from_spark(df.schema))
        todo = [n for n in nodes if isinstance(n.op, StatOperator) and not n.op.fitted]
        while todo:
            waiting = {id(n) for n in todo}
            phase = [n for n in todo if not any(id(x) in waiting for x in n.post_order() if x is not n)]
            self._fit_phase(phase, Columns.of(df))
            todo = [n for n in todo if not n.op.fitted]

    @staticmethod
    def _fit_phase(phase: list[Node], root: Columns) -> None:
        done: dict[int, Columns] = {}
        groups: dict[int, list[tuple[Node, dict]]] = {}
        bases: dict[int, DataFrame] = {}
        for n in phase:
            parts = [p.compile(root, done) for p in [*n.dependencies, *n.parents]]
            columns = Columns(parts[-1].base, {k: c for x in parts for k, c in x.columns.items()})
            if n.op.fits_by_aggregates:
                groups.setdefault(id(columns.base), []).append((n, n.op.fit_expressions(n.resolved, columns)))
                bases[id(columns.base)] = columns.base
            else:
                n.op.fit_finalize(n.op.fit(n.resolved, columns.frame()))
                n.op.fitted = True
        for key, members in groups.items():
            every = [c.alias(f"a{i}_{j}") for i, (_, aggs) in enumerate(members) for j, c in enumerate(aggs.values())]
            row = iter(bases[key].agg(*every).first() if every else ())
            for n, aggs in members:
                n.op.fit_finalize({name: next(row) for name in aggs})
                n.op.fitted = True

    def fit_transform(self, data: Any) -> Any:
        return self.fit(data).transform(data)

    def clear_stats(self) -> None:
        for n in self.nodes:
            if isinstance(n.op, StatOperator):
                n.op.clear()
                n.op.fitted = False
        for g in self.subgraphs.values():
            g.clear_stats()

    # descriptions
    def export(self) -> str:
        """The plan as JSON: nodes in order, with their operators and columns."""
        number = {id(n): i for i, n in enumerate(self.nodes)}
        rows = []
        for n in self.nodes:
            op = n.op.export("", n.input_schema or Schema(), n.output_schema or Schema()) if n.op else {"operator": "input", "outputs": (n.output_schema or Schema()).column_names}
            rows.append(op | {"id": number[id(n)], "parents": [number[id(p)] for p in n.parents], "dependencies": [number[id(p)] for p in n.dependencies]})
        return json.dumps(rows, indent=1, default=str)

    def to_dot(self) -> str:
        number = {id(n): i for i, n in enumerate(self.nodes)}
        lines = [f'  {number[id(n)]} [label={json.dumps(n.label)}];' for n in self.nodes]
        lines += [f"  {number[id(p)]} -> {number[id(n)]};" for n in self.nodes for p in n.parents]
        lines += [f"  {number[id(p)]} -> {number[id(n)]} [style=dashed];" for n in self.nodes for p in n.dependencies]
        return "digraph {\n" + "\n".join(lines) + "\n}"


class Executor:
    """fit and transform of graphs over datasets."""

    def fit(self, data: Any, graph: Any, refit: bool = True) -> Graph:
        graph = graph if isinstance(graph, Graph) else Graph(graph)
        return graph.fit(data, refit)

    def transform(self, data: Any, graph: Any) -> Any:
        graph = graph if isinstance(graph, Graph) else Graph(graph)
        return graph.transform(data)

    def fit_transform(self, data: Any, graph: Any) -> Any:
        graph = graph if isinstance(graph, Graph) else Graph(graph)
        return graph.fit_transform(data)


class Runtime:
    """Runs graphs, with other operators in the place of some: op_table maps operator classes to functions that make the
    replacement."""

    def __init__(self, executor: Executor | None = None):
        self.executor = executor or Executor()
        self.op_table: dict[type[Operator], Any] = {}

    def convert(self, graph: Graph) -> Graph:
        for n in graph.nodes:
            if n.op is not None and type(n.op) in self.op_table:
                n.op = self.op_table[type(n.op)](n.op)
        return graph

    def transform(self, graph: Any, data: Any) -> Any:
        graph = graph if isinstance(graph, Graph) else Graph(graph)
        return self.executor.transform(data, self.convert(graph))

    def export(self, graph: Graph) -> str:
        return graph.export()


__all__ = ["ColumnSelector", "Executor", "Graph", "Runtime"]
