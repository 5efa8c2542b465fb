"""Statistics in parts, cubes, variants, and names of files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import ColumnSchema, Cube, Dataset, Graph, Schema, Standardize, dtype
from tessera.functions import variants
from tessera.operators import states
from tessera.plans.selector import ColumnSelector
from tessera.sources import sinks


def test_states_of_parts_merge_to_that_of_all(spark):
    r = random.Random(1)
    values = [r.choice([None, float("nan"), r.gauss(1e6, 3)]) for _ in range(500)]
    df = spark.createDataFrame([(i % 3, v, 7) for i, v in enumerate(values)], "part int, x double, c int")
    parts = [states.state_of(df.filter(F.col("part") == p), ["x", "c"]) for p in range(3)] + [states.state_of(df.limit(0), ["x", "c"])]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = {x["column"]: x for x in states.read_off(states.merged(every)).collect()}
    x = np.array([v for v in values if v is not None and not math.isnan(v)])
    assert (got["x"]["rows"], got["x"]["nulls"]) == (len(x), 500 - len(x)) and got["x"]["low"] == x.min() and got["x"]["high"] == x.max()
    assert got["x"]["mean"] == pytest.approx(x.mean(), rel=1e-12) and got["x"]["std"] == pytest.approx(x.std(ddof=1), rel=1e-6)
    assert got["x"]["distinct"] == pytest.approx(len(set(x)), rel=0.03) and got["x"]["quantiles"] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75], method="inverted_cdf"))
    assert got["c"]["std"] == 0 and got["c"]["distinct"] == 1
    none = states.read_off(states.merged(states.state_of(df.filter("x IS NULL"), ["x"]))).first()
    assert none["rows"] == 0 and none["mean"] is None and none["std"] is None and none["quantiles"] is None


def test_scales_learned_part_by_part(spark, tmp_path):
    df = spark.createDataFrame([(float(i * i % 37),) for i in range(60)], "x double")
    whole, parts = Standardize(), Standardize()
    parts.set_storage_path(str(tmp_path / "states"))
    graph = Graph(["x"] >> parts)
    for lo, hi in ((0, 10), (10, 30), (30, 40)):
        graph.fit(Dataset(df.filter((F.col("x") >= lo) & (F.col("x") < hi))))
    want = [r[0] for r in Graph(["x"] >> whole).fit_transform(Dataset(df)).to_df().collect()]
    assert [r[0] for r in graph.transform(Dataset(df)).to_df().collect()] == pytest.approx(want)
    again = Standardize()
    again.set_storage_path(str(tmp_path / "states"))
    assert again.load(spark).moments["x"] == pytest.approx(whole.moments["x"])
    again.forget(spark)
    with pytest.raises(RuntimeError):
        again.require_fitted()
    assert [r[0] for r in Graph(["x"] >> Standardize()).fit_transform(Dataset(spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double"))).to_df().collect()] == [0.0, 0.0, None]


def test_cubes_and_their_levels(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5), (None, 1, 7)], "k string, m int, v int")
    cube = Cube(total=lambda c: F.sum("v"))
    cube.fit_finalize(cube.fit(ColumnSelector(["k", "m"]), df))
    cube.fitted = True
    assert cube.results.count() == 4 + 3 + 2 + 1
    assert sorted(map(str, map(tuple, cube.level("k").collect()))) == ["('a', 5)", "('b', 5)", "(None, 7)"]
    assert sorted(map(tuple, cube.level("m").collect())) == [(1, 14), (2, 3)] and cube.level().first()[0] == 17
    flat = Cube(depth=1, total=lambda c: F.sum("v"))
    flat.fit_finalize(flat.fit(ColumnSelector(["k", "m"]), df))
    assert sorted(r["__set"] for r in flat.results.select("__set").distinct().collect()) == [1, 2, 3]
    plan = df.cube("k", "m").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    with pytest.raises(ValueError, match="no such columns"):
        cube.level("z")
    assert Graph(["k", "m"] >> Cube(n=lambda c: F.count("*"))).fit_transform(Dataset(df)).to_df().count() == 4


def test_variants(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, "x"]}, "n": 2.5}', 1), ("[3]", 2), ("no json", 3), (None, 4)], "__variant string, i int")
    out = variants.with_paths(df, "__variant", {"b": ("$.a.b[0]", "int64"), "s": ("$.a.b[1]", "str"), "n": ("$.n", "float64"), "first": ("$[0]", "int32")}, keep=False)
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(1, 1, "x", 2.5, None), (2, None, None, None, 3), (3, None, None, None, None), (4, None, None, None, None)]
    parsed = df.select(variants.parsed(F.col("__variant")).alias("v"))
    assert dtype(parsed.schema["v"].dataType).name == "variant" and dtype("variant").to_spark == parsed.schema["v"].dataType
    assert Schema.from_spark(parsed.schema)["v"] == ColumnSchema("v", dtype="variant")
    assert "OBJECT" in variants.kinds(df.limit(1), "__variant")
    assert variants.with_paths(parsed, "v", {"n": ("$.n", "float64")}).filter("n = 2.5").count() == 1


def test_files_of_one_name_stay_apart(spark, tmp_path):
    assert sinks._own_names(["f:/r/a/x.parquet", "f:/r/b/x.parquet", "f:/r/b/y.parquet"]) == ["a/x", "b/x", "y"]
    assert sinks._own_names(["f:/r/x.parquet"]) == ["x"]
    for folder, n in (("a", 3), ("b", 5)):
        Dataset(spark.range(n)).to_parquet(str(tmp_path / folder), output_files=["x"])
    out = str(tmp_path / "out")
    Dataset([str(tmp_path / "a" / "x.parquet"), str(tmp_path / "b" / "x.parquet")], spark=spark).to_parquet(out, preserve_files=True)
    assert {n: spark.read.parquet(f"{out}/{n}").count() for n in ("a/x.parquet", "b/x.parquet")} == {"a/x.parquet": 3, "b/x.parquet": 5}
    assert spark.read.parquet(f"{out}/a/x.parquet").columns == ["id"]
