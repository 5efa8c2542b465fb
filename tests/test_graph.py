"""Selectors, nodes, graphs, user functions, statistics, subgraphs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import UDF, AddMetadata, AddProperties, AddTags, ColumnSchema, ColumnSelector, Dataset, Executor, FrequencyEncode, Graph, MinMaxScale, Node, Operator, Rename, Runtime, Schema, ShiftToZero, StatOperator, Subgraph, TagAsItemFeatures, TagAsItemID, TagAsUserFeatures, TagAsUserID, Tags
from tessera.streaming.graphs import transform_stream


@pytest.fixture(scope="module")
def xy(spark):
    return spark.createDataFrame(pd.DataFrame({"x": [1, 2, 3, 4, 5], "y": [6, 7, 8, 9, 10]})).coalesce(1)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_selectors():
    s = ColumnSelector(["a", "b", ["c", "d"]])
    assert s.names == ["a", "b", "c", "d"] and s.grouped_names == ["a", "b", ("c", "d")]
    assert (s + "a").names == s.names and (s + Tags.ID).tags == [Tags.ID] and ("z" + s).names[0] == "z"
    assert (s + ColumnSelector("*")).all and ColumnSelector(["*", "a"]).all and not ColumnSelector() and bool(ColumnSelector(tags="x"))
    assert s.filter_columns(ColumnSelector(["b", "c"])).grouped_names == ["a", ("d",)]
    with pytest.raises(ValueError):
        ColumnSelector([["a", ["b"]]])
    with pytest.raises(TypeError):
        ColumnSelector([1])
    schema = Schema([ColumnSchema("a"), ColumnSchema("t", [Tags.TIME])])
    assert ColumnSelector(["a", "none"], tags=[Tags.TIME]).resolve(schema).names == ["a", "t"] and ColumnSelector("*").resolve(schema).names == ["a", "t"]


def test_nodes():
    n = ["a"] >> Rename(postfix="_x")
    assert isinstance(n, Node) and n.parents[0].selector.names == ["a"]
    chain = n + "b" + ["c"] + n
    assert len(chain.parents) == 4 and chain.label == "+" and (["z"] + n).parents[0].selector.names == ["z"]
    with pytest.raises(TypeError):
        Node.of("a") >> 5
    assert isinstance((Node.of("a") >> Operator).op, Operator) and len(chain.post_order()) >= 5
    with pytest.raises(TypeError):
        ColumnSelector([n])


def test_right_wins_and_order(spark, xy):
    ones = spark.createDataFrame([(1, 1)] * 3, "a long, b long")
    g = Graph(["a", "b"] + (["a"] >> UDF(lambda c: c + 1)))
    out = g.transform(ones)
    assert out.columns == ["b", "a"] and rows(out) == [(1, 2)] * 3
    assert Graph(["x", "y"] + Node.of(["x"])).transform(xy).columns == ["y", "x"]


def test_one_projection(xy):
    node = Node.of(["x"])
    for _ in range(10):
        node = node >> UDF(lambda c: c + 1)
    plan = Graph(node + ["y"]).transform(xy)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1 and "Join" not in plan


def test_subtraction(xy):
    assert Graph(Node.of(["x", "y"]) - ["y"]).transform(xy).columns == ["x"]
    assert Graph(["x", "y"] - (Node.of("x") >> AddTags("t"))).transform(xy).columns == ["y"]
    assert Graph(Node.of("*")[["y"]]).transform(xy).columns == ["y"]


def test_missing_columns(xy):
    with pytest.raises(ValueError, match="Missing column"):
        Graph(Node.of(["x", "none"])).transform(xy)
    with pytest.raises(ValueError, match="Missing column"):
        Graph(Node.of("x")["none"]).transform(xy)


def test_rename(xy):
    assert Graph(["x", "y"] >> Rename(postfix="_p")).transform(xy).columns == ["x_p", "y_p"]
    assert Graph(["x"] >> Rename(name="z")).transform(xy).columns == ["z"] and Graph(["x"] >> Rename(f=str.upper, postfix="no")).transform(xy).columns == ["X"]
    with pytest.raises(ValueError):
        Rename()
    with pytest.raises(ValueError):
        Graph(["x", "y"] >> Rename(name="z")).transform(xy)


def test_metadata(xy):
    for op, want in ((TagAsUserID(), [Tags.USER, Tags.ID]), (TagAsItemID(), [Tags.ITEM, Tags.ID]), (TagAsUserFeatures(), [Tags.USER]), (TagAsItemFeatures("more"), [Tags.ITEM, "more"]), (AddTags(["a"]), ["a"])):
        assert Schema.from_spark(Graph(["x"] >> op).transform(xy).schema)["x"].tags == want
    out = Schema.from_spark(Graph(["x"] >> AddProperties({"p": [1, {"q": None}]}) >> AddMetadata("t", {"r": 1})).transform(xy).schema)["x"]
    assert out.properties == {"p": [1, {"q": None}], "r": 1} and out.tags == ["t"]


def test_udf_modes(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": range(12), "b": ["apple", "fig", "plum"] * 4, "c": [0.0, 1.0] * 6})).repartition(4)
    one = lambda op, names: sorted(rows(Graph(names >> op).transform(df)), key=str)
    assert one(UDF(lambda c: c.str.slice(0, 2), dtype="str"), ["b"]) == sorted([("ap",), ("fi",), ("pl",)] * 4)
    assert sorted(one(UDF(lambda c: c.astype(float)), ["a"])) == [(float(i),) for i in range(12)]
    assert sorted(one(UDF(lambda c: np.where(c == 4, 0, 1), mode="pandas"), ["a"])) == [(0,)] + [(1,)] * 11
    two = Graph(["a"] >> UDF(lambda c, f: c - f["c"], dependency=["c"])).transform(df)
    assert two.columns == ["a"] and two.agg(F.sum("a")).first()[0] == 60
    pandas_two = Graph(["a"] >> UDF(lambda c, f: c + f["c"], dependency="c", mode="pandas")).transform(df)
    assert pandas_two.agg(F.sum("a")).first()[0] == 72
    by_node = Graph(["a"] >> UDF(lambda c, f: c + f["c_up"], dependency=(["c"] >> Rename(postfix="_up")))).transform(df)
    assert by_node.columns == ["a"] and by_node.agg(F.sum("a")).first()[0] == 72
    assert Graph(Node.of("a") >> (lambda c: c * 2)).transform(df).agg(F.sum("a")).first()[0] == 132
    assert dict(Graph(["a"] >> UDF(lambda c: c + 1, dtype="int8")).transform(df).dtypes) == {"a": "tinyint"}
    with pytest.raises(ValueError):
        UDF(None)
    with pytest.raises(ValueError):
        UDF(lambda a, b, c: a)
    with pytest.raises(ValueError):
        Graph(["b"] >> UDF(lambda c: c.str.upper(), mode="native")).transform(df)


def test_udf_labels():
    def named(c):
        return c

    assert UDF(named).label == "named" and UDF(named, label="x").label == "x" and "lambda" in UDF(lambda c: c).label


def test_dtypes_reach_the_schema(xy):
    g = Graph((["x"] >> UDF(lambda c: c / 2)) + ["y"])
    out = g.transform(Dataset(xy))
    assert out.schema["x"].dtype.name == "float64" and out.schema["y"].dtype.name == "int64" and g.output_schema["x"].dtype.name == "float64"


class Mean(StatOperator):
    def __init__(self):
        super().__init__()
        self.calls = 0

    def fit_expressions(self, selector, columns):
        return {n: F.avg(columns[n]) for n in selector.names}

    def fit_finalize(self, stats):
        self.calls += 1
        self.stats = stats

    def expressions(self, selector, columns):
        return {n: columns[n] - self.stats[n] for n in selector.names}


def test_statistics(xy):
    op = Mean()
    g = Graph((["x"] >> op) + (["y"] >> MinMaxScale()))
    with pytest.raises(RuntimeError):
        g.transform(xy)
    out = g.fit_transform(xy)
    assert op.calls == 1 and rows(out) == [(i - 2.0, i / 4) for i in range(5)]
    g.clear_stats()
    assert not op.fitted
    two = Graph(["x"] >> MinMaxScale() >> Mean() >> ShiftToZero())
    assert [r[0] for r in rows(two.fit_transform(xy))] == [0, 0.25, 0.5, 0.75, 1]
    again = Executor().fit_transform(xy, ["x"] >> Mean())
    assert again.agg(F.sum("x")).first()[0] == 0


def test_frequency_encoding(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5), ("a", 6), ("b", 7)], "s string, n int")
    out = Graph(["s"] >> FrequencyEncode()).fit_transform(df)
    assert sorted(r[0] for r in rows(out)) == [0, 1, 1, 1, 2, 2, 3]
    both = Graph((["s"] >> FrequencyEncode()) + ["n"])
    with pytest.raises(ValueError, match="rows were changed"):
        both.fit_transform(df)


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3, None), (3, None)], "x int, y double")
    assert rows(Graph(["x", "y"] >> MinMaxScale()).fit_transform(df)) == [(0.0, None)] * 2


def test_subgraphs(xy):
    double = ["x"] >> UDF(lambda c: c * 2)
    g = Graph((["x"] >> Subgraph("double", double)) + ["y"])
    assert g.subgraph("double").nodes and [r[0] for r in rows(g.transform(xy))] == [2, 4, 6, 8, 10]
    with pytest.raises(ValueError):
        g.subgraph("none")
    with pytest.raises(ValueError):
        Graph((["x"] >> Subgraph("s", double)) + (["y"] >> Subgraph("s", ["y"] >> UDF(lambda c: c))))
    fitted = Graph(["x"] >> Subgraph("scaled", ["x"] >> MinMaxScale()))
    assert [r[0] for r in rows(fitted.fit_transform(xy))] == [0, 0.25, 0.5, 0.75, 1]


def test_loops(xy):
    step = ["x"] >> UDF(lambda c: c + 1)
    out = Graph(["x"] >> Subgraph("loop", step, loop_until=lambda f: f.agg(F.min("x")).first()[0] > 20, checkpoint_every=3)).transform(xy)
    assert sorted(r[0] for r in rows(out)) == [21, 22, 23, 24, 25]
    with pytest.raises(RuntimeError):
        Graph(["x"] >> Subgraph("loop", step, loop_until=lambda f: False, most=3)).transform(xy)


def test_removed_inputs(xy):
    g = Graph(["y"] + (["x"] >> UDF(lambda c: c + 1) >> Rename(postfix="_1")) + (["y"] >> UDF(lambda c, f: c + f["x"], dependency="x") >> Rename(postfix="_2")))
    g.construct_schema(Schema.from_spark(xy.schema))
    assert g.column_mapping() == {"y": ["y"], "x_1": ["x"], "y_2": ["y", "x"]}
    out = g.remove_inputs(["x"])
    assert out.transform(xy.drop("x")).columns == ["y"] and out.output_schema.column_names == ["y"] and out.input_schema.column_names == ["y"]
    assert g.transform(xy).columns == ["y", "x_1", "y_2"]


class TopRows(Operator):
    def transform(self, selector, df):
        return df.filter("x > 3")


def test_operators_that_change_rows(xy):
    assert rows(Graph(["x", "y"] >> TopRows() >> UDF(lambda c: c * 10)).transform(xy)) == [(40, 90), (50, 100)]
    with pytest.raises(ValueError):
        Graph((["x"] >> TopRows()) + ["y"]).transform(xy)


def test_runtime_and_descriptions(xy):
    g = Graph(["x"] >> Rename(postfix="_1"))
    runtime = Runtime()
    runtime.op_table[Rename] = lambda op: Rename(postfix="_2")
    assert runtime.transform(g, xy).columns == ["x_2"] and '"Rename"' in g.export() and "->" in g.to_dot()
    assert len(g.get_nodes_by_op_type(Rename)) == 1 and len(g.leaf_nodes) == 1


def test_groups(spark):
    seen = []

    class Look(Operator):
        def expressions(self, selector, columns):
            seen.append(selector.grouped_names)
            return super().expressions(selector, columns)

    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    Graph(["a", ["b", "c"]] >> Look()).transform(df)
    Graph([Node.of("a"), ["b"] >> Rename(postfix="_x")] >> Look()).transform(df)
    assert seen[0] == ["a", ("b", "c")] and seen[1] == [("a", "b_x")]


def test_streams(spark, xy, tmp_path):
    with pytest.raises(ValueError):
        transform_stream(["x"] >> UDF(lambda c: c), xy)
    xy.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(xy.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        transform_stream(["x"] >> TopRows(), stream)
    assert transform_stream(["x"] >> UDF(lambda c: c + 1), stream).isStreaming
