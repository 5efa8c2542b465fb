"""Reading, writing, joining and moving data."""

import json
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import ColumnSchema, Dataset, Schema, Shuffle, Tags, queries
from tessera.functions import frames, joins, lists, scalars
from tessera.functions.table import TensorColumn, TensorTable, group_values_offsets, ungroup_values_offsets
from tessera.sources import dataset, readers, sinks
from tessera.sources.avro import AvroDataSource, blocks, write_container, write_containers

from .conftest import SF


@pytest.fixture(scope="module")
def data(spark):
    pdf = pd.DataFrame({"id": range(60), "name": ["ann", "bob"] * 30, "x": np.arange(60) / 2, "y": [i % 5 for i in range(60)]})
    return spark.createDataFrame(pdf).repartition(3)


def as_set(df):
    return sorted(map(str, df.collect()))


def test_sources_in_memory(spark):
    pdf = pd.DataFrame({"a": [1, 2], "l": [[1.0], [2.0, 3.0]]})
    for source in (pdf, pa.table({"a": [1, 2], "l": [[1.0], [2.0, 3.0]]}), {"a": [1, 2], "l": [[1.0], [2.0, 3.0]]}, spark.createDataFrame(pdf)):
        d = Dataset(source, npartitions=2, spark=spark)
        assert d.num_rows == 2 and d.schema["l"].is_ragged and d.npartitions == 2
    assert Dataset(Dataset(pdf)).schema.column_names == ["a", "l"] and len(Dataset(pdf).head(1)) == 1 and len(Dataset(pdf).tail(1)) == 1
    with pytest.raises(TypeError):
        Dataset(pdf, schema=["a"])


def test_formats(spark, data, tmp_path):
    with pytest.raises(ValueError):
        readers.detect_format("x.bin")
    assert readers.detect_format("a/b.csv.gz") == "csv" and readers.detect_format("b.parquet") == "parquet"
    data.write.csv(str(tmp_path / "c"), header=True, sep="\t")
    assert as_set(Dataset(str(tmp_path / "c"), sep="\t", spark=spark).to_df().select("id", "name")) == as_set(data.select("id", "name"))
    data.write.csv(str(tmp_path / "n"))
    d = Dataset(str(tmp_path / "n"), engine="csv", names=["id", "name", "x", "y"], dtypes={"y": "int32"}, spark=spark)
    assert dict(d.to_df().dtypes)["y"] == "int" and d.num_rows == 60
    readers.register_engine("twice", lambda s, paths: s.range(len(paths) * 2))
    assert Dataset(["b2", "a10", "a9"], engine="twice", spark=spark).num_rows == 6 and Dataset(["b2", "a10", "a9"], engine="twice", spark=spark).paths == ["a9", "a10", "b2"]
    with pytest.raises(ValueError):
        Dataset("x", engine="none", spark=spark)


def test_filters(spark, data, tmp_path):
    Dataset(data).to_parquet(str(tmp_path / "h"), partition_on="name")
    read = lambda f: Dataset(str(tmp_path / "h"), engine="parquet", filters=f, spark=spark)
    assert read([("name", "==", "ann")]).num_rows == 30 and read([[("y", "in", [0, 1])], [("x", ">=", 29)]]).num_rows == 26
    assert read([("name", "!=", "ann"), ("y", "<", 1)]).num_rows == 6
    plan = read([("x", ">", 20.0)]).to_df(["x"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), GreaterThan(x,20.0)]" in plan and "ReadSchema: struct<x:double>" in plan
    with pytest.raises(ValueError):
        read([("x", "~", 1)])


def test_output_files(spark, data, tmp_path):
    d = Dataset(data.repartition(6))
    d.to_parquet(str(tmp_path / "n"), output_files=2)
    assert sorted(p.name for p in (tmp_path / "n").glob("*.parquet")) == ["part_0.parquet", "part_1.parquet"]
    d.to_parquet(str(tmp_path / "names"), output_files=["b", "a", "c"])
    assert sorted(p.name for p in (tmp_path / "names").glob("*.parquet")) == ["a.parquet", "b.parquet", "c.parquet"]
    d.to_parquet(str(tmp_path / "dict"), output_files={"one": [0, 1], ("two", "three"): [4, 5]})
    lens = d.partition_lens
    assert Dataset(str(tmp_path / "dict"), spark=spark).num_rows == lens[0] + lens[1] + lens[4] + lens[5]
    with pytest.warns(UserWarning):
        Dataset(data.coalesce(1)).to_parquet(str(tmp_path / "few"), output_files=4)
    assert as_set(Dataset(str(tmp_path / "few"), spark=spark).to_df()) == as_set(data)
    Dataset(str(tmp_path / "names"), spark=spark).to_parquet(str(tmp_path / "same"), preserve_files=True)
    for name in "abc":
        assert pq.read_table(tmp_path / "same" / f"{name}.parquet").num_rows == pq.read_table(tmp_path / "names" / f"{name}.parquet").num_rows
    for bad in ({"partition_on": "name", "output_files": 2}, {"partition_on": ["id", "name", "x", "y"]}, {"method": "none"}, {"shuffle": Shuffle.FULL}, {"shuffle": "x"}, {"preserve_files": True, "output_files": 1}):
        with pytest.raises(ValueError):
            d.to_parquet(str(tmp_path / "bad"), **bad)


def test_row_groups_and_metadata(spark, tmp_path):
    Dataset(spark.range(50_000).coalesce(1)).to_parquet(str(tmp_path / "g"), row_group_size=5000, write_metadata_file=True, output_files=1)
    meta = pq.ParquetFile(tmp_path / "g" / "part_0.parquet").metadata
    assert meta.num_row_groups == 10 and meta.row_group(0).column(0).compression == "UNCOMPRESSED" and (tmp_path / "g" / "_metadata").exists()
    assert readers.parquet_metadata(str(tmp_path / "g" / "part_0.parquet")) == (50_000, 10, ["id"])


def test_shuffles(spark, data, tmp_path):
    for how in (Shuffle.PER_PARTITION, Shuffle.PER_WORKER):
        Dataset(data).to_parquet(str(tmp_path / how.value), shuffle=how)
        assert as_set(Dataset(str(tmp_path / how.value), spark=spark).to_df()) == as_set(data)
    with pytest.warns(DeprecationWarning):
        assert sinks.shuffle_of(True) == Shuffle.PER_WORKER
    a, b = (Dataset(data).shuffle_rows(seed=s).to_df().collect() for s in (1, 2))
    assert a != b and sorted(map(str, a)) == sorted(map(str, b)) and len(Dataset(data).shuffle_rows(7, 1).to_df().collect()) == 7


def test_sidecars(spark, data, tmp_path):
    s = Schema([ColumnSchema("id", [Tags.USER_ID], {"embedding_sizes": {"cardinality": 3, "dimension": 2.0}}, "int64"), ColumnSchema("name", [Tags.CATEGORICAL], dtype="str"), ColumnSchema("x", dtype="float64"), ColumnSchema("y", [Tags.TARGET], dtype="int64")])
    path = tmp_path / "s"
    Dataset(data, schema=s).to_parquet(str(path), cats=["id"], conts=["x"], labels=["y"], write_schema_text=True, write_keyset=True, output_files=2)
    back = Dataset(str(path), spark=spark)
    assert back.schema["id"].tags == [Tags.USER, Tags.ID] and back.schema["name"].dtype.name == "str" and back.num_rows == 60
    listed = (path / "_file_list.txt").read_text().split("\n")
    meta = json.loads((path / "_metadata.json").read_text())
    assert listed[0] == "2" and sum(f["num_rows"] for f in meta["file_stats"]) == 60 and meta["labels"] == [{"col_name": "y", "index": 3}]
    assert (path / "_keyset").read_bytes() == np.arange(4, dtype=">u4").tobytes()
    (path / ".schema" / "schema.json").unlink()
    assert Dataset(str(path), spark=spark).schema["y"].tags == [Tags.TARGET]
    Dataset(data, schema=s).to_parquet(str(tmp_path / "t"), dtypes={"x": "float32"})
    assert Dataset(str(tmp_path / "t"), spark=spark).schema["x"].dtype.name == "float32"
    Dataset(data, schema=s).to_parquet(str(tmp_path / "hive"), partition_on=["name"])
    assert Dataset(str(tmp_path / "hive" / "name=ann"), spark=spark).schema["y"].tags == [Tags.TARGET]


def test_validation_and_regeneration(spark, data, tmp_path):
    pq.write_table(pa.table({"a": [1], "b": [2]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"a": pa.array([None], pa.null()), "b": [2]}), tmp_path / "2.parquet")
    with pytest.warns(UserWarning, match="differ in schema"):
        assert not _two(tmp_path, spark).validate()
    out = Dataset(data).regenerate(str(tmp_path / "r"), columns=["id", "x"], order=["id"])
    assert out.schema.column_names == ["id", "x"] and [r["id"] for r in out.to_df().collect()] == list(range(60)) and out.validate(file_min_size=0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert not Dataset(data).validate() and not out.validate(require_metadata_file=True)


def test_regenerated_files_are_put_together_from_small_sorts(spark, tmp_path, monkeypatch):
    """Rows with many types, ties and nulls, in order through files, none of which has all rows."""
    rows = spark.range(30_000).selectExpr("id", "IF(id % 7 = 0, NULL, id % 5) AS k", "named_struct('a', id, 'b', array(id, NULL)) AS s", "CAST(id AS decimal(20, 3)) AS d", "timestamp_seconds(id) AS t", "CAST(id AS string) AS name")
    monkeypatch.setattr(dataset, "FILE_BYTES", 600_000)
    monkeypatch.setattr(dataset, "SORT_BYTES", 100_000)
    for at, order in (("o", ["k"]), ("n", None)):
        moved = rows.repartition(3)
        out = Dataset(moved).regenerate(str(tmp_path / at), order=order)
        names = sorted(p for p in (tmp_path / at).iterdir() if p.suffix == ".parquet")
        parts = [pq.read_table(p).to_pylist() for p in sorted(names, key=lambda p: int(p.stem[5:]))]
        assert len(parts) > 2 and max(map(len, parts)) < 20_000 and out.to_df().exceptAll(rows).isEmpty() and sum(map(len, parts)) == 30_000
        assert out.to_df().schema.simpleString() == rows.schema.simpleString()
        if order:
            ks = [(r["k"] is not None, r["k"] or 0) for p in parts for r in p]
            assert ks == sorted(ks)


def test_validated_files_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_FILE_ROWS", 400, raising=False)
    monkeypatch.setattr(queries, "scratch", lambda spark, name: str(tmp_path / name))
    queries.validate_dataset(spark, SF)
    rows = [pq.read_metadata(p).num_rows for p in (tmp_path / "validate").glob("*.parquet")]
    assert len(rows) == 3 and sum(rows) == 1500 and max(rows) < 700


def _two(path, spark):
    d = Dataset(str(path / "1.parquet"), spark=spark)
    d.paths = [str(path / "1.parquet"), str(path / "2.parquet")]
    return d


def test_merge_is_that_of_pandas(spark):
    a = pd.DataFrame({"k": pd.array([1, 2, None, 2], "Int64"), "v": ["a", "b", "c", "d"], "w": [1, 2, 3, 4]})
    b = pd.DataFrame({"k": pd.array([2, None, 5], "Int64"), "v": ["x", "y", "z"], "u": [7, 8, 9]})
    for how in ("inner", "left", "right", "outer"):
        got = Dataset.merge(Dataset(pa.Table.from_pandas(a)), Dataset(pa.Table.from_pandas(b)), on="k", how=how).to_df()
        want = a.merge(b, on="k", how=how)
        assert got.columns == list(want.columns)
        clean = lambda rows: sorted(str([None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r]) for r in rows)
        assert clean(map(tuple, got.collect())) == clean(want.itertuples(index=False)), how
    assert Dataset.merge(spark.createDataFrame(pa.Table.from_pandas(a)), spark.createDataFrame(pa.Table.from_pandas(b)), on="k", null_safe=False).num_rows == 2
    with pytest.raises(ValueError):
        Dataset.merge(spark.range(1), spark.range(1).toDF("x"))
    with pytest.raises(ValueError):
        Dataset.merge(spark.range(1), spark.range(1), on="id", how="cross")


def test_partitions(spark, data):
    d = Dataset(data)
    by = d.shuffle_by_keys("name", npartitions=2)
    assert by.to_df().select("name", F.spark_partition_id().alias("p")).distinct().groupBy("name").count().filter("count > 1").count() == 0
    assert d.shuffle_by_keys("id", npartitions=50).npartitions <= 3 and d.repartition(5).npartitions == 5 and sum(d.partition_lens) == 60
    assert d.repartition(partition_size="100MB").npartitions >= 1
    it = d.to_iter(columns=["id"], epochs=2, shuffle=True, seed=1)
    assert len(it) == 120 and sorted(pd.concat(list(it))["id"]) == sorted([*range(60)] * 2)
    assert len(d.to_iter(indices=[0])) == d.partition_lens[0] == sum(map(len, d.to_iter(indices=[0])))


@pytest.mark.parametrize("null_safe", [True, False])
def test_keys_with_many_pairs_meet_in_tiles(spark, monkeypatch, null_safe):
    """Copies, null keys and keys of one side only; no task gets all pairs of a key."""
    a = spark.createDataFrame([(1, i // 2) for i in range(50)] + [(None, i) for i in range(40)] + [(2, 7), (3, 8)], "k int, x int")
    b = spark.createDataFrame([(1, i // 3) for i in range(60)] + [(None, i) for i in range(30)] + [(2, 5), (4, 9)], "k int, y int")
    merged = lambda: Dataset.merge(a, b, on="k", how="outer", indicator=True, null_safe=null_safe).to_df()
    plain = sorted(map(str, merged().collect()))
    monkeypatch.setattr(joins, "TILE", 8)
    monkeypatch.setattr(joins, "PAIRS", 100)
    tiled = merged()
    assert sorted(map(str, tiled.collect())) == plain and len(plain) == 3000 + (1200 if null_safe else 70) + 3
    each = [r["n"] for r in tiled.filter("k = 1").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(each) < 1500


def test_a_path_is_read_by_as_many_partitions_as_its_bytes_ask_for(spark, tmp_path):
    """Not more where there are more cores; a path that is a folder of files goes by its own name."""
    rows = spark.range(3_000_000).select("id", F.rand(1).alias("x"))
    rows.coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "one" / "orders.parquet"))
    rows.repartition(3).write.parquet(str(tmp_path / "some" / "orders.parquet"))
    for folder in ("one", "some"):
        assert [tuple(r) for r in queries.file_partition_map(spark, str(tmp_path / folder)).collect()] == [("orders.parquet", [0])]
    paths = [str(tmp_path / folder / "orders.parquet") for folder in ("one", "some")]
    assert Dataset(paths[0], spark=spark).npartitions > 1 == Dataset(paths[0], spark=spark, part_size="1GB").npartitions
    several = Dataset(paths[1:], spark=spark, part_size=1 << 20)
    assert len(several.path_partition_map["orders.parquet"]) == 3 and several.num_rows == 3_000_000  # each file is one row group


def test_settings_of_the_session_stay(spark, data, tmp_path):
    """part_size and row groups hold for one read and one write; iterating runs each partition once."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    Dataset(data).to_parquet(str(tmp_path / "p"), output_files=1)
    small = Dataset(str(tmp_path / "p"), part_size=500, spark=spark)
    whole = Dataset(str(tmp_path / "p"), spark=spark)
    assert small.npartitions > 1 == whole.npartitions and small.num_rows == 60 and spark.conf.get(name) == before
    assert Dataset(str(tmp_path / "p"), aggregate_files=True, spark=spark).npartitions == 1
    Dataset(data).regenerate(str(tmp_path / "r"), row_group_bytes=1 << 20)
    assert spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size") is None
    runs = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            runs.add(1)
            yield f

    d = Dataset(data.repartition(3).mapInPandas(count, data.schema))
    assert sum(map(len, d.to_iter())) == 60 and runs.value == 3
    shuffled = small.to_df(shuffle=True, seed=2)
    assert as_set(shuffled) == as_set(data)


def test_binary_rows(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0.5, 7), (0.0, 1.5, 9)], "label float, c float, k long").coalesce(1)
    Dataset(df).to_binary(str(tmp_path / "b"), cats=["k"], conts=["c"], labels=["label"])
    raw = next((tmp_path / "b").glob("*.bin")).read_bytes()
    assert np.frombuffer(raw[:64], "<i8").tolist() == [0, 2, 1, 1, 1, 0, 0, 0]
    assert raw[64:] == b"".join(np.array([a, b], "<f4").tobytes() + np.array([1], "<i4").tobytes() + np.array([k], "<u4").tobytes() for a, b, k in ((1, 0.5, 7), (0, 1.5, 9)))


def test_npy(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (3, [5, 6])], "id long, e array<long>")
    for append in (False, True):
        Dataset(df.coalesce(1)).to_npy(str(tmp_path / "a.npy"), append)
        assert np.load(tmp_path / "a.npy").tolist() == [[1, 1, 2], [2, 3, 4], [3, 5, 6]]
    with pytest.raises(ValueError):
        Dataset(spark.createDataFrame([(None,), (1,)], "a int")).to_npy(str(tmp_path / "b.npy"))
    with pytest.raises(TypeError):
        Dataset(spark.createDataFrame([("x",)], "a string")).to_npy(str(tmp_path / "c.npy"), append=True)


def test_writers_work_by_partition(spark, tmp_path, monkeypatch):
    """Tasks write; no rows of the table come to the driver, and every partition has its file."""
    df = spark.range(1000).selectExpr("id", "array(id, id + 1) AS e", "cast(id AS float) AS x").repartitionByRange(4, "id")
    fields = [{"name": "id", "type": "long"}]
    monkeypatch.setattr(type(df), "toArrow", lambda *_: pytest.fail("rows on the driver"))
    Dataset(df.select("id", "e")).to_npy(f"file:{tmp_path}/a.npy")
    assert np.load(tmp_path / "a.npy").tolist() == [[i, i, i + 1] for i in range(1000)]
    write_containers(df, f"file:{tmp_path}/avro", {"type": "record", "name": "r", "fields": fields}, "deflate")
    assert len(list((tmp_path / "avro").glob("*.avro"))) == 4
    assert sorted(r["id"] for r in Dataset(f"file:{tmp_path}/avro", spark=spark).to_df().collect()) == list(range(1000))
    write_containers(df.limit(0), f"{tmp_path}/none", {"type": "record", "name": "r", "fields": fields})
    assert Dataset(f"{tmp_path}/none", spark=spark).to_df().count() == 0
    Dataset(df).to_binary(f"{tmp_path}/b", cats=["id"], conts=[], labels=["x"])
    assert sum(f.stat().st_size - 64 for f in (tmp_path / "b").glob("*.bin")) == 12 * 1000


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(spark, tmp_path, codec):
    schema = {"type": "record", "name": "user", "fields": [{"name": "name", "type": "string"}, {"name": "age", "type": ["null", "int"]}, {"name": "tags", "type": {"type": "array", "items": "long"}}]}
    people = [{"name": f"n{i}é", "age": None if i % 7 == 0 else i - 50, "tags": [i] * (i % 3)} for i in range(500)]
    for i in range(2):
        write_container(str(tmp_path / f"{i}.avro"), schema, people, codec, block_rows=100)
    assert len(list(blocks(str(tmp_path / "0.avro")))) == 5 and AvroDataSource.name() == "tessera_avro"
    d = Dataset(str(tmp_path), part_size=10, spark=spark)
    assert d.num_rows == 1000 and d.npartitions == 10
    one = Dataset(str(tmp_path / "0.avro"), spark=spark).to_df().collect()
    assert [(r["name"], r["age"], r["tags"]) for r in one] == [(p["name"], p["age"], p["tags"]) for p in people]
    with pytest.raises(ValueError):
        readers.read_avro(spark, ["x"], other=1)


def test_lookup(spark, data, tmp_path):
    Dataset(data).to_parquet(str(tmp_path / "l"), output_files=1)
    t = readers.lookup_table(spark, str(tmp_path / "l"), cache="disk", cats_only=True, columns=["id"])
    assert sorted(r["labels"] for r in t.collect()) == list(range(60)) and t.is_cached
    t.unpersist()


def test_lists(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (4, [4])], "k int, v array<int>")
    assert [r["end_offset"] for r in lists.offsets(df, "v", "k").orderBy("k").collect()] == [3, 3, 3, 4]
    assert lists.columnwise_explode(df, "v").columns == ["k", "v_0", "v_1", "v_2"] and lists.flatten_list(df, "v").count() == 4
    assert [r[0] for r in df.select(lists.pad(F.col("v"), 2, F.lit(0))).collect()] == [[1, 2], [0, 0], None, [4, 0]]
    flat = lists.positions(df, "k", "v")
    assert sorted((r["k"], r["v"]) for r in lists.regroup(flat, "k", "position", "value", "v").collect()) == [(1, [1, 2, 3]), (4, [4])]
    assert lists.is_fixed(df.filter("k = 1"), "v").first()[0] and not lists.is_fixed(df, "v").first()[0]
    nested = spark.createDataFrame([([[1, 2], [3]],)], "n array<array<int>>")
    assert lists.flatten_list(nested, "n", None).count() == 3 and scalars.list_val_dtype(nested, "n").simpleString() == "int" and scalars.is_list_dtype(nested, "n")


def test_scalars(spark):
    df = spark.createDataFrame([("e21f5d58",), ("0",), (None,), ("7fffffff",), ("ffffffff",)], "h string")
    assert [r[0] for r in df.select(scalars.hex_to_int(F.col("h"))).collect()] == [-501260968, 0, None, 2147483647, -1]
    assert df.agg(scalars.has_nulls(F.col("h"))).first()[0] and df.select(scalars.hash_series(F.col("h"))).distinct().count() == 5


def test_frames(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 4.0), (4, "b", None), (5, "b", 2.0)], "i int, k string, v double")
    assert [r["v"] for r in frames.interpolate(df, "v", "i").orderBy("i").collect()] == [1.0, 2.5, 4.0, 3.0, 2.0]
    assert [r["v"] for r in frames.shift(df, "v", "i", 1, ["k"]).orderBy("i").collect()] == [None, 1.0, None, None, None]
    assert [r["rank"] for r in frames.ranked(df, F.desc("i")).orderBy("i").collect()] == [5, 4, 3, 2, 1]
    assert frames.reduce_columns(df, "quantile", ["i"], 0.25).first()[0] == 2 and frames.reduce_columns(df, "product", ["i"]).first()[0] == 120
    assert frames.explode(spark.createDataFrame([([1, 2],), ([],)], "a array<int>"), "a").count() == 3
    assert frames.shape(df) == (5, 3) and frames.to_dict(df)["i"] == [1, 2, 3, 4, 5] and frames.to_numpy(df.select("i")).shape == (5, 1)
    assert frames.add_to_column(df, "i", [9]).count() == 6 and frames.sample(df, 3).count() == 3 and len(frames.describe(df).collect()) > 3
    assert frames.apply(df, lambda p: p.assign(i=p["i"] + 1)[["i"]], "i int").agg(F.sum("i")).first()[0] == 20
    assert frames.pipe(df, lambda d, n: d.limit(n), 2).count() == 2 and frames.transpose(df.select("k", "i").filter("i < 3").withColumn("k", F.col("i").cast("string")), "k").count() == 1


def test_tensor_tables(spark):
    df = spark.createDataFrame([(1.0, [1, 2], [1]), (2.0, [3, 4], [2, 3])], "s double, f array<long>, r array<long>")
    schema = Schema([ColumnSchema("s", dtype="float64"), ColumnSchema("f", dtype="int64", dims=(None, 2)), ColumnSchema("r", dtype="int64", dims=(None, None))])
    t = TensorTable.from_df(df, schema)
    assert t["f"].shape == (2, 2) and t["r"].offsets.tolist() == [0, 1, 3] and t["r"][-1].tolist() == [2, 3] and set(t.to_dict()) == {"s", "f", "r__values", "r__offsets"}
    assert TensorTable(t.to_dict()) == t and sorted(map(str, t.to_df(spark).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        TensorTable.from_df(df, Schema([ColumnSchema("r", dtype="int64", dims=(None, 2))]))
    for bad in ([1, 2], [0, 3, 2], [0, 1]):
        with pytest.raises(ValueError):
            TensorColumn([1, 2], bad)
    with pytest.raises(ValueError):
        TensorTable({"a": [1], "b": [1, 2]})
    with pytest.raises(IndexError):
        t["s"][2]
    t.columns = ["x", "y", "z"]
    assert t.columns == ["x", "y", "z"] and t.num_rows == 2 and list(t[["x"]]) == ["x"]
    flat = {"a__values": [1, 2], "a__offsets": [0, 2], "b": [1]}
    assert ungroup_values_offsets(group_values_offsets(flat)) == flat
