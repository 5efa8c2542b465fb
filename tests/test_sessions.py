"""Sessions, comparisons and frames in memory."""

import pytest

from tessera import Dataset, TensorTable
from tessera.functions import frames
from tessera.functions.testing import assert_equal
from tessera.sources.session import Distributed, Serial, session


def test_sessions(spark):
    assert session() is not None
    with Distributed() as s:
        assert s.range(3).count() == 3
    with Distributed(force_new=True, **{"spark.sql.shuffle.partitions": 3}) as s:
        assert s.conf.get("spark.sql.shuffle.partitions") == "3"
    with Serial() as s:
        assert s.conf.get("spark.sql.shuffle.partitions") == "1"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_comparisons(spark):
    a = frames.from_dict(spark, {"x": [1, 2], "y": ["a", "b"]})
    assert_equal(a, Dataset(a.orderBy("y", ascending=False)))
    with pytest.raises(Exception, match="DIFFERENT"):
        assert_equal(a, a.limit(1))
    t = TensorTable({"x": [1, 2]})
    assert_equal(t, a.select("x"))
    with pytest.raises(AssertionError):
        assert_equal(t, TensorTable({"x": [1, 3]}))


def test_frames_in_memory(spark):
    assert [r["n"] for r in frames.arange(spark, 2, 8, 2, "n").collect()] == [2, 4, 6]
    assert frames.filled(spark.range(2), "z", 0, "float").dtypes[1] == ("z", "float")
