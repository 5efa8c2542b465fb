"""Placement without shuffles, ranges of keys, ordered functions over ranges, and the joins made of them."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import Dataset
from tessera.functions import frames, ranges, segments
from tessera.functions.segments import Segments, asof_join
from tessera.sources import placed

from .conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


# ordered functions over ranges


def some_rows(r, n, keys):
    """(k, t, x, i): few keys, of which one has most rows; ties in t, nulls everywhere."""
    out = [(r.choice(keys), r.choice([None, *range(40)]), r.choice([None, None, r.randrange(100)]), i) for i in range(n)]
    return [(keys[0], t, x, i) if r.random() < 0.6 else (k, t, x, i) for k, t, x, i in out]


def by_key(rows):
    order = lambda v: (v is not None, v or 0)
    rows = sorted(rows, key=lambda row: (order(row[0]), order(row[1]), row[3]))
    return [list(g) for _, g in itertools.groupby(rows, key=lambda row: row[0])]


@pytest.mark.parametrize(("n", "seed"), [(1, 1), (7, 2), (400, 3)])
def test_segments_against_loops(spark, n, seed):
    rows = some_rows(random.Random(seed), n, ["a", None, "b", "c"])
    df = spark.createDataFrame(rows, "k string, t int, x int, i int")
    s = Segments(df, ["k"], ["t", "i"])
    s.number(), s.total(), s.shift("x", 2, "lag"), s.shift("x", -3, "lead"), s.running_sum("x"), s.last_value("x"), s.last_value("x", "next", back=True), s.ntile(3)
    want = []
    for g in by_key(rows):
        xs, m = [row[2] for row in g], len(g)
        tiles = [1 + next(t for t in range(3) if at < sum(m // 3 + (u < m % 3) for u in range(t + 1))) for at in range(m)]
        for at, row in enumerate(g):
            seen = [x for x in xs[: at + 1] if x is not None]
            after = [x for x in xs[at:] if x is not None]
            want.append((*row, at + 1, m, xs[at - 2] if at >= 2 else None, xs[at + 3] if at + 3 < m else None, sum(seen) if seen else None, seen[-1] if seen else None, after[0] if after else None, tiles[at]))
    assert rows_of(s.frame("number", "total", "lag", "lead", "running", "last", "next", "ntile")) == sorted(map(str, want))


def test_ranks_with_ties_over_ranges(spark):
    rows = [("a", 1, 0, i) for i in range(60)] + [("a", 2, 0, i) for i in range(90)] + some_rows(random.Random(5), 100, ["a", "b"])
    s = Segments(spark.createDataFrame(rows, "k string, t int, x int, i int"), ["k"], ["t"])
    s.rank(), s.rank("dense", dense=True)
    want = []
    for g in by_key(rows):
        ts = [row[1] for row in g]
        want += [(*row, ts.index(row[1]) + 1, len(set(map(str, ts[: at + 1])))) for at, row in enumerate(g)]
    assert rows_of(s.frame("rank", "dense")) == sorted(map(str, want))
    assert len({r["part"] for r in s.base.select("part").distinct().collect()}) > 2


def test_ranks_look_once_at_the_rows(spark):
    """Ties over several ranges, none within one, and from the end; both ranks by one job over the rows that were stored."""
    rows = [("a", i // 40, i) for i in range(200)] + [("b", i % 3, i) for i in range(90)] + [("c", None, i) for i in range(9)]
    for descending in (False, True):
        s = Segments(spark.createDataFrame(rows, "k string, t int, i int"), ["k"], ["t"], descending=descending)
        s.rank(), s.rank("dense", dense=True)
        line = s.frame("rank", "dense")
        assert line._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2 and "lag(" not in line._jdf.queryExecution().toString()
        order = "DESC" if descending else "ASC"
        want = spark.createDataFrame(rows, "k string, t int, i int").selectExpr("*", f"CAST(rank() OVER (PARTITION BY k ORDER BY t {order}) AS long)", f"CAST(dense_rank() OVER (PARTITION BY k ORDER BY t {order}) AS long)")
        assert rows_of(line) == rows_of(want)


@pytest.mark.parametrize("periods", [1, -1, 5, -5, 0])
def test_long_shifts_join_by_number(spark, monkeypatch, periods):
    rows = some_rows(random.Random(6), 80, ["a", "b", None])
    df = spark.createDataFrame(rows, "k string, t int, x int, i int")
    near, far = Segments(df, ["k"], ["t", "i"]), Segments(df, ["k"], ["t", "i"])
    near.shift("x", periods)
    monkeypatch.setattr(segments, "CARRIED", 0)
    far.shift("x", periods)
    assert rows_of(near.frame("shifted")) == rows_of(far.frame("shifted"))


def test_shift_and_interpolate_of_keys_and_of_all(spark):
    rows = [("a", i, [1.0, None, None, 7.0, None][i % 5]) for i in range(30)] + [("b", i, None if i < 3 else 2.0) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, t int, `c.x` double")
    for keys in (["k"], None):
        got = {(r[0], r[1]): r[2] for r in frames.interpolate(df.filter("k = 'a' OR t >= 0"), "c.x", "t", keys).collect()}
        if keys:
            for k in "ab":
                x = pd.Series([row[2] for row in rows if row[0] == k]).interpolate()
                assert [got[(k, i)] if got[(k, i)] is not None else float("nan") for i in range(len(x))] == pytest.approx(x.tolist(), nan_ok=True)
    moved = {(r[0], r[1]): r[2] for r in frames.shift(df, "c.x", "t", 2, ["k"]).collect()}
    assert moved[("a", 2)] == 1.0 and moved[("a", 0)] is None and moved[("b", 5)] == 2.0


def test_values_after_a_row_cost_no_frame_to_the_end(spark):
    """Spark aggregates a frame from the row to the end anew for each row, so that time grows with the square of a range."""
    s = Segments(spark.range(100).selectExpr("id", "IF(id % 5 = 0, id, NULL) AS x"), None, ["id"])
    s.last_value("x", "next", back=True)
    out = s.frame("next")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    assert [r["next"] for r in out.orderBy("id").collect()] == [-(-i // 5) * 5 if i <= 95 else None for i in range(100)]


def test_segments_of_odd_frames(spark):
    empty = Segments(spark.createDataFrame([], "k int, part int, i int, row int, o int"), ["k"], ["i"])
    empty.number(), empty.rank("place"), empty.shift("row"), empty.last_value("o"), empty.running_sum("i"), empty.ntile(2), empty.interpolate("o")
    assert empty.frame("number", "place", "shifted", "last", "running", "ntile", "line").collect() == []
    same = Segments(spark.createDataFrame([(float("nan"), 1, 5)] * 50, "k double, part int, i int"), ["k"], ["part"])
    same.number(), same.rank(), same.running_sum("i")
    out = same.frame("number", "rank", "running").collect()
    assert sorted(r["number"] for r in out) == list(range(1, 51)) and {r["rank"] for r in out} == {1} and sorted(r["running"] for r in out) == list(range(5, 255, 5))


# joins


@pytest.mark.parametrize("keyed", [True, False])
def test_asof_against_loops(spark, keyed):
    r = random.Random(7)
    left = [(i, r.choice(["a", "b", None]), r.choice([None, *range(50)])) for i in range(120)]
    right = [(i, r.choice(["a", "a", "b", None, "z"]), r.choice([None, *range(50)]), r.choice([None, i])) for i in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "j int, k string, t int, v int")
    got = asof_join(a, b, "t", "t", [("k", "k")] if keyed else None, ["j", "t", "v"], ["j"])
    assert got.columns == ["i", "k", "t", "j", "t_right", "v"]
    want = []
    for i, k, t in left:
        fit = [(u, j, v) for j, q, u, v in right if t is not None and u is not None and u <= t and (not keyed or (k is not None and q == k))]
        u, j, v = max(fit, default=(None, None, None), key=lambda x: x[:2])
        want.append((i, k, t, j, u, v))
    assert rows_of(got) == sorted(map(str, want))
    assert asof_join(a.limit(0), b, "t", "t").count() == 0 and asof_join(a, b.limit(0), "t", "t").filter("j IS NOT NULL").count() == 0


def intervals(r, n):
    out = []
    for i in range(n):
        s = r.randrange(-500, 500)
        out.append((i, r.choice(["a", "b", None]), s, s + r.choice([0, 1, 2, 3, 7, 8, 60, 64, 1000, 100_000, -1])))
    return [*out, (n, "a", None, 5), (n + 1, "a", 5, None)]


@pytest.mark.parametrize("keyed", [True, False])
def test_overlaps_against_loops(spark, keyed):
    r = random.Random(8)
    left, right = intervals(r, 90), intervals(r, 70)
    kinds = "i int, k string, s long, e long"
    a, b = spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds)
    by = [("k", "k")] if keyed else None
    ok = lambda x: x[2] is not None and x[3] is not None and x[2] <= x[3]
    meets = lambda x, y: ok(x) and ok(y) and x[2] <= y[3] and y[2] <= x[3] and (not keyed or (x[1] is not None and x[1] == y[1]))
    got = ranges.overlap_join(a, b, ("s", "s"), ("e", "e"), by)
    assert got.columns == ["i", "k", "s", "e", "i_right", "k_right", "s_right", "e_right"]
    assert rows_of(got) == sorted(str(x + y) for x in left for y in right if meets(x, y))
    assert rows_of(ranges.overlap_join(a, a, ("s", "s"), ("e", "e"), by)) == sorted(str(x + y) for x in left for y in left if meets(x, y))
    assert "NestedLoop" not in plan_of(got) and "CartesianProduct" not in plan_of(got)
    assert ranges.overlap_join(a.limit(0), b, ("s", "s"), ("e", "e")).count() == 0


def test_a_long_interval_costs_few_rows(spark):
    one = spark.createDataFrame([(0, 2**40)], "s long, e long")
    cells = ranges._cells(ranges._gridded(one, "s", "e", [], "l"), "l", [1, 5, 20, 50])
    assert cells.count() <= 4


def test_top_k_against_sorting(spark):
    r = random.Random(9)
    rows = [(r.choice(["a"] * 8 + ["b", None]), r.choice([None, *range(9)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x int, __place int")
    got = ranges.top_k(df, ["k"], [F.desc_nulls_last("x"), F.asc("__place")], 3)
    want = []
    for k in ("a", "b", None):
        want += sorted((row for row in rows if row[0] == k), key=lambda row: (row[1] is None, -(row[1] or 0), row[2]))[:3]
    assert rows_of(got) == sorted(map(str, want)) and got.columns == df.columns
    assert plan_of(got).count("WindowGroupLimit") >= 2


# placement


def sizes_of(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_parts_of_equal_weight(spark):
    steep = spark.range(12_000).selectExpr("CAST(floor(12000 / (1 + id)) AS INT) AS k", "1 AS same")
    for df, key, n in ((steep, "k", 12), (steep.withColumn("k", F.col("k") / 7.0), "k", 5), (steep.withColumn("k", F.timestamp_seconds("k")), "k", 9), (steep.withColumn("k", F.expr("CASE WHEN k > 1 THEN k END")), "k", 8)):
        out, split = ranges.weighted_parts(df, key, n)
        sizes = sizes_of(out)
        assert sum(sizes) == 12_000 and max(sizes) <= 1.2 * 12_000 / n and out.columns == df.columns
        whole = out.filter(F.col(key).isNotNull()).select(key, F.spark_partition_id().alias("p")).distinct().groupBy(key).count().filter("count > 1").count()
        assert whole == len(split)
    one = spark.range(1000).selectExpr("5 AS k")
    assert max(sizes_of(ranges.weighted_parts(one, "k", 4)[0])) <= 300
    assert ranges.weighted_parts(one.limit(0), "k", 4)[0].count() == 0


def test_folders_are_read_whole_and_without_a_shuffle(spark, tmp_path):
    rows = [(i, ["x", "y", "z", None][i % 4], i % 3) for i in range(240)]
    path = str(tmp_path / "hive")
    Dataset(spark.createDataFrame(rows, "i int, k string, m int")).to_parquet(path, partition_on=["k", "m"])
    data = Dataset(path, engine="parquet", spark=spark)
    for keys, n in ((["k"], 4), (["k", "m"], 12)):
        for asked in (2, 3, 100):
            held = data.shuffle_by_keys(keys, hive_data=True, npartitions=asked)
            assert "Exchange" not in plan_of(held.to_df()) and rows_of(held.to_df(["i", "k", "m"])) == sorted(map(str, rows))
            at = held.to_df().select(*keys, F.spark_partition_id().alias("p")).distinct().collect()
            assert len(at) == n and 1 < len({r["p"] for r in at}) <= asked
    with pytest.raises(ValueError, match="folders"):
        data.shuffle_by_keys("i", hive_data=True)


def test_buckets_need_no_shuffle(spark, tmp_path):
    left = spark.createDataFrame([(i % 50, i) for i in range(600)], "a int, i int")
    right = spark.createDataFrame([(i, str(i)) for i in range(40)], "b int, s string")
    paths = [str(tmp_path / x) for x in "lr"]
    Dataset(left).to_buckets(paths[0], "a", 4)
    Dataset(right).to_buckets(paths[1], ["b"], 4)
    a, b = (Dataset(p, engine="parquet", spark=spark) for p in paths)
    assert a.placed_by == ["a"] and a.shuffle_by_keys(["a", "i"]) is a and rows_of(a.to_df()) == rows_of(left)
    grouped = a.to_df().groupBy("a").count()
    assert "Exchange" not in plan_of(grouped) and rows_of(grouped) == rows_of(left.groupBy("a").count())
    merged = Dataset.merge(a.to_df().hint("merge"), b.to_df().hint("merge"), left_on="a", right_on="b", null_safe=False).to_df()
    assert "Exchange" not in plan_of(merged) and merged.count() == 480
    where = placed.Files(spark, paths[0])
    spark.sql(f"DROP TABLE {placed._table(where.fs.makeQualified(where.root).toString())}")  # as in another session
    again = Dataset(paths[0], engine="parquet", spark=spark)
    assert "Exchange" not in plan_of(again.to_df().groupBy("a").count()) and again.num_rows == 600
    assert again.shuffle_by_keys("i").to_df().count() == 600


def test_counts_come_from_footers(spark, tmp_path):
    counted = placed.footer_counts(spark, [f"{SF}/lineitem.parquet"])
    assert "PushedAggregation: [COUNT(*)]" in plan_of(counted) and counted.first()["count"] == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    data = Dataset(f"{SF}/lineitem.parquet", spark=spark)
    assert data.num_rows == data.to_df().count()
    some = Dataset(f"{SF}/lineitem.parquet", spark=spark, filters=[("l_quantity", ">", 25)])
    assert 0 < some.num_rows < data.num_rows and some.num_rows == some.to_df().count()
    assert data.apply(lambda df: df.limit(3)).num_rows == 3
    path = str(tmp_path / "h")
    Dataset(spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "i int, k string")).to_parquet(path, partition_on=["k"])
    assert rows_of(placed.footer_counts(spark, [path], ["k"])) == ["('x', 1)", "('y', 2)"]
