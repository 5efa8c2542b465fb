"""Types, shapes, tags, schemas and their files."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tessera import ColumnSchema, ColumnSelector, Dimension, Schema, Shape, Tags, TagSet, dtype
from tessera.plans.tags import normalise
from tessera.plans import dtypes as D
from tessera.plans import schema_io


def test_dimensions():
    assert Dimension().is_unknown and Dimension(2, 2).is_fixed and int(Dimension(3, 3)) == 3 and Dimension(1, 4).is_variable and not Dimension(1).is_bounded
    for bad in ((None, None), (-1, 2), (3, 2), (1.5, 2), (0, -1)):
        with pytest.raises(ValueError):
            Dimension(*bad)
    with pytest.raises(ValueError):
        int(Dimension(1, 2))


def test_shapes():
    assert Shape() == Shape((1, 2)) and Shape((None, 3)) != Shape((None, 4)) and Shape(None).is_unknown
    assert not Shape((5,)).is_list and Shape((None, 4)).is_list and not Shape((None, 4)).is_ragged and Shape((None, (0, 4))).is_ragged
    assert Shape((None, (2, 5), 3)).as_tuple == (None, (2, 5), 3)


def test_types_of_other_libraries():
    assert dtype("int32") == D.int32 and dtype(np.float32) == D.float32 and dtype(np.dtype("uint8")) == D.uint8 and dtype(int) == D.int64 and dtype(str) == D.string
    assert dtype(T.LongType()) == D.int64 and dtype(T.ArrayType(T.ArrayType(T.FloatType()))).shape.as_tuple == (None, None, None)
    assert dtype("nonsense") == D.unknown and dtype(T.MapType(T.StringType(), T.LongType())) == D.unknown
    assert D.uint32.to_spark == T.LongType() and D.float16.to_spark == T.FloatType() and D.int8.to("numpy") == np.dtype("int8") and D.boolean.to("python") is bool
    with pytest.raises(TypeError):
        dtype(None)
    with pytest.raises(ValueError):
        D.int8.to("no such library")


def test_registered_mappings():
    class Other:
        pass

    kind = Other()
    D.register("other", {D.int16: kind})
    assert D.int16.to("other") is kind and dtype(kind) == D.int16


def test_tags():
    assert TagSet(["USER_ID"]) == {Tags.USER, Tags.ID} and Tags.USER_ID in TagSet([Tags.ID, "user"]) and "Free" in TagSet("free")
    with pytest.raises(ValueError):
        TagSet([Tags.CONTINUOUS, "categorical"])
    assert TagSet("continuous").override("categorical") == [Tags.CATEGORICAL]
    assert TagSet(["a"]) + ["b"] == ["b", "a"] and TagSet(["a", "b"]) - ["b"] == ["a"]
    assert len(TagSet([Tags.BINARY_CLASSIFICATION])) == 1


def test_column_shapes():
    c = ColumnSchema("x", dtype="int64", properties={"value_count": {"min": 2, "max": 5}})
    assert c.is_list and c.is_ragged and c.value_count == Dimension(2, 5)
    assert ColumnSchema("x", properties={"value_count": {"max": 4}}, is_ragged=False).shape.as_tuple == (None, 4)
    assert ColumnSchema("x", dims=(None, 3)).properties["value_count"] == {"min": 3, "max": 3}
    assert ColumnSchema("x", dtype=D.int8.with_shape((None, 2))).is_list
    assert c.with_shape((None,)).properties == {} and not c.with_dtype("int8", is_list=False).is_list and c.with_dtype("int8").is_list
    for bad in ({"is_list": False, "is_ragged": True}, {"dims": (None, 3), "is_ragged": True}, {"dims": (None,), "is_list": True}):
        with pytest.raises(ValueError):
            ColumnSchema("x", **bad)
    d = ColumnSchema("x", dtype="int32", properties={"domain": {"min": 0, "max": 0}})
    assert d.int_domain.is_bounded and d.float_domain is None and ColumnSchema("x", dtype="uint8", properties={"domain": {"min": 0, "max": 3}}).int_domain.max == 3


def shop():
    return Schema([ColumnSchema("price", ["money", "item"]), ColumnSchema("tax", ["money"]), ColumnSchema("shelf", ["place", "item"]), ColumnSchema("town", ["place"])])


@pytest.mark.parametrize(("a", "b"), [("categorical", "continuous"), ("embedding", "categorical"), ("continuous", "embedding"), ("user_id", "continuous"), ("embedding", "item_id")])
def test_contradictory_tags(a, b):
    with pytest.raises(ValueError, match="not both") as e:
        ColumnSchema("x", [a, b])
    assert all(x in str(e.value) for x in (a.removeprefix("user_").removeprefix("item_"), b.removeprefix("user_").removeprefix("item_")))
    with pytest.raises(ValueError, match="not both"):
        TagSet(a) | b
    assert TagSet([a, "own"]).override(b).tags >= TagSet(b).tags and normalise(a) not in TagSet([a, "own"]).override(b).tags and "own" in TagSet([a, "own"]).override(b)


def test_selection():
    s = shop()
    assert s.select_by_tag("money").column_names == ["price", "tax"] and s.select_by_tag(["money", "place"]).column_names == s.column_names
    assert s.select_by_tag(["place", "item"], pred_fn=all).column_names == ["shelf"] and s.excluding_by_tag("item").column_names == ["tax", "town"]
    assert s.select(ColumnSelector(["town", "none"], tags=["money"])).column_names == ["town", "price", "tax"] and s.select("*") == s and s.excluding(ColumnSelector("tax")).column_names == ["price", "shelf", "town"]
    ids = Schema([ColumnSchema("u", [Tags.USER]), ColumnSchema("i", [Tags.USER, Tags.ID])])
    assert ids.select_by_tag(Tags.USER_ID).column_names == ["i"] and ids.select_by_tag([Tags.USER, Tags.ID]).column_names == ["u", "i"]
    with pytest.raises(KeyError):
        s[["price", "none"]]
    assert s.get("none") is None and s.first.name == "price" and s.without(["price"]).column_names == ["tax", "shelf", "town"] and len(s.to_pandas()) == 4


names = st.lists(st.sampled_from("abcdef"), unique=True)


@settings(max_examples=60, deadline=None)
@given(names, names)
def test_algebra(a, b):
    x, y = Schema(a), Schema([ColumnSchema(n, ["right"]) for n in b])
    both = x + y
    assert both.column_names == [n for n in a if n not in b] + b
    assert all("right" in both[n].tags for n in b) and (x - y).column_names == [n for n in a if n not in b]
    assert x + None == x and x - None == x and None + x == x


def test_merging_of_columns():
    a = Schema([ColumnSchema("x", [Tags.CONTINUOUS], {"p": 1}, "int32")])
    b = Schema([ColumnSchema("x", [Tags.CATEGORICAL], {"q": 2}, "int64")])
    c = (a + b)["x"]
    assert c.dtype == D.int64.with_shape(c.shape.dims) and c.tags == [Tags.CATEGORICAL] and c.properties == {"p": 1, "q": 2}


SHAPES = [None, (None,), (None, None), (None, 4), (None, (1, 4)), (None, 2, (0, 3))]


@pytest.mark.parametrize(("shape", "kind"), list(itertools.product(SHAPES, ["int32", "uint8", "float64", "str", "bool", "datetime64[us]", "unknown"])))
def test_files_keep_schemas(shape, kind):
    s = Schema([ColumnSchema("x", ["item", Tags.USER_ID], {"domain": {"min": 1, "max": 331, "name": "n"}, "embedding_sizes": {"cardinality": 9, "dimension": 2.0}, "list": [{"a": 1}]}, kind, dims=shape), ColumnSchema('odd "name"\n')])
    for back in (schema_io.from_json(schema_io.to_json(s)), schema_io.from_text(schema_io.to_text(s))):
        assert back == s or (kind in ("str", "bool", "datetime64[us]", "unknown") and back["x"].tags == s["x"].tags and back["x"].shape == s["x"].shape)
        assert back["x"].dtype.name == kind and back.column_names == s.column_names


def test_files_of_other_tools():
    text = '{"feature": [{"name": "shelves", "type": "INT", "valueCount": {"min": "2", "max": "7"}, "intDomain": {"min": "10", "max": "52", "isCategorical": true}, "annotation": {"tag": ["context"]}}]}'
    c = schema_io.from_json(text)["shelves"]
    assert c.tags == [Tags.CONTEXT, Tags.CATEGORICAL] and c.value_count == Dimension(2, 7) and c.int_domain.max == 52 and c.dtype.name == "int64"
    pb = 'feature {\n  name: "x"\n  type: FLOAT\n  float_domain { min: 0.5 max: 2 }\n  annotation { tag: "continuous" }\n} # done\nfeature { name: "y" type: INT }'
    s = schema_io.from_text(pb)
    assert s.column_names == ["x", "y"] and s["x"].float_domain.min == 0.5 and s["y"].dtype.name == "int64"


def test_spark_metadata(spark):
    s = Schema([ColumnSchema("a", [Tags.USER_ID], {"domain": {"min": 0, "max": 3}}, "uint8"), ColumnSchema("b", dtype="float32", dims=(None, 3))])
    struct = s.to_spark()
    assert struct["a"].dataType == T.ShortType() and struct["b"].dataType == T.ArrayType(T.FloatType())
    back = Schema.from_spark(spark.createDataFrame([], struct).filter("a > 1").select("b", "a").schema)
    assert back["a"].tags == s["a"].tags and back["a"].dtype.name == "uint8" and back["b"].shape.as_tuple == (None, 3)
    assert s.to_spark_frame(spark).count() == 2


def test_random_schemas_survive_text():
    r = random.Random(1)
    for _ in range(30):
        s = Schema([ColumnSchema(f"c{i}", r.sample(["item", "id", "time", "x y"], r.randint(0, 3)), {"k": r.choice(["é", 'a"b', 1, 2.5, True])}, r.choice(["int8", "float32"]), dims=(None,)) for i in range(r.randint(0, 5))])
        assert schema_io.from_text(schema_io.to_text(s)).column_names == s.column_names and schema_io.from_json(schema_io.to_json(s)) == s
