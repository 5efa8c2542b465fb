"""Statistics that follow a stream."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import stats


def test_a_stream_in_pieces_is_the_batch(spark, tmp_path):
    path, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    keys, made = {"k": F.col("k")}, {"n": F.count("*"), "s": F.sum("v")}
    rows = [("a", 1), ("b", 2), (None, 3), ("a", 4), ("c", 5), ("a", 6), ("b", 7), (None, 8), ("d", 9), ("c", 0)]
    for i in range(0, len(rows), 2):  # a run for each piece, from where the last one stopped
        spark.createDataFrame(rows[i : i + 2], "k string, v int").coalesce(1).write.mode("append").parquet(path)
        stats.follow(spark.readStream.schema("k string, v int").parquet(path), keys, made, out, progress).awaitTermination()
    batch = lambda: sorted(map(str, map(tuple, stats.followed(spark, out, ["k"]).collect())))
    want = sorted(str((k, len(v), sum(v))) for k in ("a", "b", "c", "d", None) for v in [[y for x, y in rows if x == k]])
    assert batch() == want
    assert stats.settle(spark, out, ["k"]) == 4 and batch() == want
    assert stats.settle(spark, out, ["k"]) == 0
    assert [tuple(r) for r in stats.codes(spark, out, "k", "n").orderBy("code").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    state = stats.state(spark, progress).select("key.k", "value").collect()
    assert {r["k"] for r in state} == {"a", "b", "c", "d", None}
    with pytest.raises(ValueError, match="stream"):
        stats.follow(spark.range(1), {}, made, out, progress)


def test_late_rows_are_dropped(spark, tmp_path):
    path, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    keys, made = {"w": F.window("t", "1 hour")}, {"n": F.count("*")}
    for stamps in (["00:10", "05:00"], ["05:30"], ["00:20", "05:40"]):
        spark.createDataFrame([(x,) for x in stamps], "x string").selectExpr("to_timestamp('2024-01-01 ' || x) AS t").coalesce(1).write.mode("append").parquet(path)
        stats.follow(spark.readStream.schema("t timestamp").parquet(path), keys, made, out, progress, ("t", "1 hour")).awaitTermination()
    got = {str(r["w"]["start"])[11:16]: r["n"] for r in stats.followed(spark, out, ["w"]).collect()}
    assert sorted(got.values()) == [1, 3]
