"""Dataset: a DataFrame with the meaning of its columns, and where it came from."""

from __future__ import annotations

import math
import random
import re
import warnings
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, row_hash, shuffled
from ..functions.joins import full_join, keys_equal
from ..operators.base import quoted
from ..plans.schema import ColumnSchema, Schema
from . import placed, sinks
from .files import Files, natural
from .readers import ENGINES, cast_columns, detect_format, parquet_metadata, paths_of

#: Bytes of rows, as their types have them, of the files that are regenerated (fewer than twice these), and of a range that
#: a task sorts for them.
FILE_BYTES, SORT_BYTES = 400_000_000, 32_000_000


class Dataset:
    """source: a path or paths, a Spark, pandas or Arrow table, a dict of columns, or another dataset. engine: parquet,
    csv, avro, a registered name, or a function (spark, paths, **options) -> DataFrame. schema: of the columns; else that
    beside the files, else what Spark says. dtypes: casts. Device and cluster arguments of other engines (client, cpu,
    part_mem_fraction, storage_options) are taken and have no effect."""

    def __init__(self, source: Any, engine: Any = None, npartitions: int | None = None, part_size: Any = None, part_mem_fraction: float | None = None, storage_options: dict | None = None, dtypes: dict | None = None, client: Any = None, cpu: bool | None = None, base_dataset: Any = None, schema: Schema | None = None, spark: SparkSession | None = None, **options: Any):
        if schema is not None and not isinstance(schema, Schema):
            raise TypeError(f"schema is a Schema, not {type(schema).__name__}")
        self.paths: list[str] | None = None
        self.base_dataset = base_dataset or self
        self.dtypes = dtypes
        self.engine = engine
        self.placed_by: list[str] = []  # rows with equal values of these are in one partition, and Spark knows it
        if isinstance(source, Dataset):
            self.placed_by = source.placed_by
            source, schema = source.to_df(), schema or source.schema
        if isinstance(source, DataFrame):
            spark = source.sparkSession
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        if isinstance(source, str | Path) or (isinstance(source, list | tuple) and source and isinstance(source[0], str | Path)):
            self.paths = paths_of(source)
            kind = engine or self._detected()
            if npartitions is not None:
                warnings.warn("npartitions holds for data in memory; files are split by part_size", stacklevel=2)
            size = _bytes(part_size)
            # a partition has these bytes, not fewer if there are more cores
            split = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(min(size or 0, 4 << 20)), "spark.sql.files.minPartitionNum": "1"}
            reading = own_session(self.spark, split) if size and kind != "avro" else self.spark
            if not callable(kind) and kind not in ENGINES:
                raise ValueError(f"no such engine: {kind}")
            read = kind if callable(kind) else ENGINES[kind]
            if kind == "avro" and size:
                options["part_size"] = size
            self.placed_by = placed.bucket_keys(self.spark, self.paths) if kind == "parquet" and not options and not size else []
            self._df = placed.bucketed(self.spark, self.paths[0]) if self.placed_by else read(reading, self.paths, **options)
            self._plain_files = kind == "parquet" and not options.get("filters")
            schema = schema or sinks.find_schema(self.spark, self.paths[0])
        else:
            self._df = self._in_memory(source)
            if npartitions:
                self._df = self._df.repartition(npartitions)
            elif part_size:
                warnings.warn("part_size holds for files; give npartitions", stacklevel=2)
        if dtypes:
            self._df = cast_columns(self._df, dtypes)
        seen = Schema.from_spark(self._df.schema)
        if schema is None:
            self.schema = seen
        else:  # columns that the schema does not know keep what Spark says of them
            known = [c.with_dtype(seen[c.name].dtype.without_shape) if c.name in seen and c.dtype.name == "unknown" else c for c in schema if c.name in seen]
            self.schema = Schema([*known, *(c for c in seen if c.name not in schema)])

    def _detected(self) -> str:
        f = Files(self.spark, self.paths[0])
        if f.is_dir():
            for pattern, kind in (("*.parquet", "parquet"), ("*.csv*", "csv"), ("*.avro", "avro")):
                if f.list(pattern):
                    return kind
            if any(n.endswith(".parquet") for n in f.sizes()):
                return "parquet"
        return detect_format(self.paths[0])

    def _in_memory(self, source: Any) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        if isinstance(source, dict):
            import pyarrow as pa

            source = pa.table(source)
        if hasattr(source, "to_arrow"):
            source = source.to_arrow()
        return self.spark.createDataFrame(source)

    # rows
    def to_df(self, columns: list[str] | None = None, shuffle: bool = False, seed: int | None = None) -> DataFrame:
        """The lazy DataFrame, with the columns' meaning in its metadata. shuffle: rows by a hash and a seed within the
        partitions, and the partitions themselves."""
        names = columns or self._df.columns
        df = self._df.select(*(quoted(n).alias(n, metadata=self.schema[n].metadata()) if n in self.schema else quoted(n) for n in names))
        if not shuffle:
            return df
        n = sinks.partition_count(df)
        order = list(range(n))
        random.Random(seed).shuffle(order)
        moved = df.repartitionById(max(1, n), F.array(*map(F.lit, order or [0]))[F.spark_partition_id()])
        return moved.sortWithinPartitions(row_hash(df, seed or 0))

    to_ddf = to_df

    def compute(self):
        return self.to_df().toPandas()

    def persist(self) -> Dataset:
        self._df = self._df.persist()
        return self

    def head(self, n: int = 5):
        return self._df.limit(n).toPandas()

    def tail(self, n: int = 5):
        import pandas as pd

        return pd.DataFrame([r.asDict() for r in self._df.tail(n)], columns=self._df.columns)

    def sample_data(self, n: int = 1):
        return self.head(n)

    @property
    def num_rows(self) -> int:
        """From the footers of Parquet files, which tasks read, where the dataset is files as they are; else counted."""
        if self.paths and getattr(self, "_plain_files", False):
            return placed.footer_counts(self.spark, self.paths).first()[0]
        return self._df.count()

    @property
    def npartitions(self) -> int:
        return sinks.partition_count(self._df)

    @property
    def partition_lens(self) -> list[int]:
        """Rows of each partition, empty ones too."""
        counted = dict(map(tuple, self._df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*")).collect()))
        return [counted.get(i, 0) for i in range(self.npartitions)]

    @property
    def file_partition_map(self) -> dict[str, list[int]]:
        """Names of files to the partitions that read them."""
        rows = self._df.select(F.col("_metadata.file_name").alias("f"), F.spark_partition_id().alias("p")).distinct().collect()
        out: dict[str, list[int]] = {}
        for r in sorted(rows, key=lambda r: (natural(r["f"]), r["p"])):
            out.setdefault(r["f"], []).append(r["p"])
        return out

    @property
    def path_partition_map(self) -> dict[str, list[int]]:
        """Names of the paths that were given, files or folders, to the partitions that read them."""
        roots = {p: Files(self.spark, p) for p in self.paths or []}
        full = {p: f.fs.makeQualified(f.root).toUri().toString().rstrip("/") for p, f in roots.items()}
        rows = self._df.select(F.col("_metadata.file_path").alias("f"), F.spark_partition_id().alias("p")).distinct().collect()
        return {p.rstrip("/").rsplit("/", 1)[-1]: sorted({r["p"] for r in rows if _within(r["f"], at)}) for p, at in full.items()}

    @property
    def file_metadata(self) -> list[tuple[int, int, list[str]]]:
        return [parquet_metadata(f"{p.rstrip('/')}/{n}" if Files(self.spark, p).is_dir() else p) for p in self.paths or [] for n in ([x for x in Files(self.spark, p).sizes() if x.endswith(".parquet")] if Files(self.spark, p).is_dir() else [p])]

    def to_iter(self, columns: list[str] | None = None, indices: list[int] | None = None, shuffle: bool = False, seed: int = 0, use_file_metadata: bool | None = None, epochs: int = 1) -> DataFrameIter:
        return DataFrameIter(self, columns, indices, shuffle, seed, epochs)

    # partitions
    def repartition(self, npartitions: int | None = None, partition_size: Any = None) -> Dataset:
        """By number, or by the bytes that a partition may have, of which Spark estimates the total."""
        if partition_size is not None:
            npartitions = max(1, math.ceil(estimated_bytes(self._df) / _bytes(partition_size)))
        return self._like(self._df.repartition(npartitions or self.npartitions), self.schema)

    def shuffle_by_keys(self, keys: str | list[str], hive_data: bool | None = None, npartitions: int | None = None) -> Dataset:
        """Rows with equal keys in one partition; never more partitions than there are. Nothing moves if the dataset is
        stored in buckets by some of the keys. hive_data: the files are in folders by these keys; each partition reads
        whole folders, without a shuffle."""
        keys = [keys] if isinstance(keys, str) else keys
        if self.placed_by and set(self.placed_by) <= set(keys):
            return self
        if hive_data and not all(f"{k}=" in "".join(self._df.inputFiles()[:1]) for k in keys):
            raise ValueError(f"the data are not in folders by {keys}")
        n = min(npartitions or self.npartitions, max(1, self.npartitions))
        if hive_data:
            return self._like(placed.by_folders(self._df, keys, n), self.schema)
        return self._like(self._df.repartition(max(1, n), *map(quoted, keys)), self.schema)

    def sort(self, *order: Any) -> Dataset:
        return self._like(self._df.orderBy(*order), self.schema)

    def shuffle_rows(self, size: int | None = None, seed: int = 0) -> Dataset:
        return self._like(shuffled(self._df, size, seed), self.schema)

    def _like(self, df: DataFrame, schema: Schema | None) -> Dataset:
        out = Dataset(df, schema=schema, base_dataset=self.base_dataset)
        out.paths = self.paths
        return out  # what was read is not as it is any more, so num_rows counts

    # joins and unions
    @classmethod
    def merge(cls, left: Any, right: Any, on: Any = None, left_on: Any = None, right_on: Any = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), indicator: bool | str = False, null_safe: bool = True, **kwargs: Any) -> Dataset:
        """An equi-join as of pandas: nulls equal nulls unless null_safe is false, other columns of equal names get
        suffixes, keys of an outer join are put together. The schema is read anew from the result."""
        if kwargs:
            raise TypeError(f"merge does not take {sorted(kwargs)}")
        a, b = (x.to_df() if isinstance(x, Dataset) else x for x in (left, right))
        listed = lambda k: [k] if isinstance(k, str) else list(k)
        if on is None and left_on is None:
            on = [c for c in a.columns if c in b.columns]
            if not on:
                raise ValueError("there are no columns to merge on")
        lk, rk = (listed(on), listed(on)) if on is not None else (listed(left_on), listed(right_on))
        if len(lk) != len(rk):
            raise ValueError("left_on and right_on are of one length")
        hows = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}
        if how not in hows:
            raise ValueError(f"how is one of {sorted(hows)}")
        l = a.toDF(*(f"l{i}" for i in range(len(a.columns))))  # noqa: E741
        r = b.toDF(*(f"r{i}" for i in range(len(b.columns))))
        l, r = (x.withColumn(f"__{side}", F.lit(True)) for x, side in ((l, "l"), (r, "r")))  # noqa: E741
        keys = [(f"l{a.columns.index(x)}", f"r{b.columns.index(y)}") for x, y in zip(lk, rk, strict=True)]
        joined = full_join(l, r, keys, null_safe) if how == "outer" else l.join(r, keys_equal(keys, null_safe), hows[how])
        shared = {x for x, y in zip(lk, rk, strict=True) if x == y}
        both = {c for c in a.columns if c in b.columns} - shared
        out = []
        for i, c in enumerate(a.columns):
            if c in shared:
                key = F.when(F.col("__l").isNotNull(), F.col(f"l{i}")).otherwise(F.col(f"r{b.columns.index(c)}"))
                out.append((key if how in ("outer", "right") else F.col(f"l{i}")).alias(c))
            else:
                out.append(F.col(f"l{i}").alias(c + suffixes[0] if c in both else c))
        out += [F.col(f"r{i}").alias(c + suffixes[1] if c in both else c) for i, c in enumerate(b.columns) if c not in shared]
        if indicator:
            side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
            out.append(side.alias(indicator if isinstance(indicator, str) else "_merge"))
        return cls(Dataset(joined.select(*out))._plain())

    def _plain(self) -> DataFrame:
        return self._df.select(*(quoted(c).alias(c, metadata={}) for c in self._df.columns))

    @classmethod
    def concat(cls, *parts: Any) -> Dataset:
        from ..functions.frames import concat_rows

        return cls(concat_rows(*(p.to_df() if isinstance(p, Dataset) else p for p in parts)))

    # sinks
    def to_parquet(self, output_path: str, shuffle: Any = None, preserve_files: bool = False, output_files: Any = None, out_files_per_proc: int | None = None, row_group_size: int | None = None, num_threads: int = 0, dtypes: dict | None = None, cats: list | None = None, conts: list | None = None, labels: list | None = None, suffix: str = ".parquet", partition_on: Any = None, method: str | None = None, write_keyset: bool = False, **options: Any) -> None:
        if preserve_files:
            if not self.paths or output_files is not None or out_files_per_proc or partition_on:
                raise ValueError("preserve_files is for a dataset that was read from files, and goes without other names")
            frame = self._df.select("*", F.col("_metadata.file_path").alias("__path"))
            df = frame.select(*(quoted(c).alias(c, metadata=self.schema[c].metadata()) if c in self.schema else quoted(c) for c in frame.columns))
            return sinks.to_parquet(df, str(output_path), self.schema, shuffle=shuffle, preserve_files=True, row_group_size=row_group_size, dtypes=dtypes, cats=cats, conts=conts, labels=labels, suffix=suffix, method=method, source_files=F.col("__path"), keyset=write_keyset, **options)
        sinks.to_parquet(self.to_df(), str(output_path), self.schema, shuffle=shuffle, output_files=output_files, out_files_per_proc=out_files_per_proc, row_group_size=row_group_size, dtypes=dtypes, cats=cats, conts=conts, labels=labels, suffix=suffix, partition_on=partition_on, method=method, keyset=write_keyset, **options)
        return None

    def to_buckets(self, output_path: str, keys: str | list[str], buckets: int, sort_by: list[str] | None = None) -> None:
        """Parquet files of rows that share a bucket by a hash of keys, sorted within; datasets that are read from there
        group by the keys, and are merged with others of as many buckets, without a shuffle."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        placed.write_buckets(self.to_df(), str(output_path), keys, buckets, sort_by or keys)
        sinks.write_sidecars(Files(self.spark, str(output_path)), self.schema, None, None, None, False, False)

    def to_binary(self, output_path: str, cats: list[str], conts: list[str], labels: list[str], shuffle: Any = None, dtypes: dict | None = None, **_: Any) -> None:
        df = cast_columns(self._df, dtypes) if dtypes else self._df
        sinks.to_binary(df, str(output_path), cats, conts, labels, self.schema, shuffle)

    def to_npy(self, output_file: str, append: bool = False) -> None:
        sinks.to_npy(self._df, str(output_file), append)

    def regenerate(self, output_path: str, columns: list[str] | None = None, file_size: Any = 12_800_000_000, row_group_bytes: int = 128_000_000, order: list[str] | None = None, **sidecars: Any) -> Dataset:
        """Rewrites rows, in their order, to files of about a size and row groups of about 128 MB. The order is that of
        the files as read, or by columns. A file is written by one task, so none is larger than FILE_BYTES; it is put
        together from ranges of SORT_BYTES, which other tasks sort."""
        df = self.to_df(columns)
        if order:
            by, moved = [*map(quoted, order)], df
        else:
            by, moved = [quoted("__at")], cut_lineage(df.withColumn("__at", F.monotonically_increasing_id()))
        total = max(estimated_bytes(df), df.count() * int(df._jdf.schema().defaultSize()))
        files = max(1, math.ceil(total / _bytes(file_size)), total // FILE_BYTES)
        ranges = max(files, math.ceil(total / SORT_BYTES))
        line = moved.repartitionByRange(ranges, *by, row_hash(moved)).sortWithinPartitions(*by)
        blocks = line.select(*map(quoted, df.columns)).mapInArrow(_blocks(files, ranges), "file int, range int, block int, rows binary")
        placed = blocks.repartitionById(files, "file").sortWithinPartitions("range", "block").select("rows").mapInArrow(_unpacked, df.schema)
        sinks.to_parquet(placed, str(output_path), self.schema.select_by_name(df.columns), row_group_bytes=row_group_bytes, **sidecars)
        return Dataset(str(output_path), engine="parquet", spark=self.spark)

    regenerate_dataset = regenerate

    def validate(self, row_group_max_size: Any = 500_000_000, file_min_size: Any = 128_000_000, require_metadata_file: bool = False) -> bool:
        """Whether the files are such as are read well: one schema, row groups not too large, files not too small, and a
        _metadata file if asked for. Says what is wrong by warnings. Files that are not Parquet are never so."""
        if not self.paths or (isinstance(self.engine, str) and self.engine != "parquet"):
            warnings.warn("only Parquet files can be validated", stacklevel=2)
            return False
        found = []
        for p in self.paths:
            f = Files(self.spark, p)
            found += [f"{p.rstrip('/')}/{n}" for n in f.sizes() if n.endswith((".parquet", ".parq", ".pq"))] if f.is_dir() else [p]
        if not found:
            warnings.warn("there are no Parquet files", stacklevel=2)
            return False
        told = placed.footers(self.spark, found).agg(F.count_distinct("schema"), F.max("largest"), F.sum("bytes")).first()
        schemas, largest, size = told
        problems = []
        if schemas > 1:
            problems.append("files differ in schema")
        if largest > _bytes(row_group_max_size):
            problems.append(f"a row group has {largest} bytes, more than {row_group_max_size}")
        if len(found) > 1 and size / len(found) < _bytes(file_min_size):
            problems.append(f"files have {size // len(found)} bytes on average, fewer than {file_min_size}")
        if require_metadata_file and not Files(self.spark, self.paths[0]).exists("_metadata"):
            problems.append("there is no _metadata file")
        for p in problems:
            warnings.warn(p, stacklevel=2)
        return not problems

    validate_dataset = validate

    # schema and devices
    def infer_schema(self, n: int = 1) -> Schema:
        """From the types that Spark knows, without looking at rows."""
        plain = Schema.from_spark(self._df.schema)
        self.schema = Schema(ColumnSchema(c.name, dtype=c.dtype.without_shape, dims=c.shape.dims) for c in plain)
        return self.schema

    def sample_dtypes(self, n: int = 1, annotate_lists: bool = False) -> dict[str, Any]:
        return {c.name: {"dtype": c.dtype.without_shape, "is_list": c.is_list} if annotate_lists else c.dtype for c in Schema.from_spark(self._df.schema)}

    def to_cpu(self) -> Dataset:
        return self

    def to_gpu(self) -> Dataset:
        """There are no devices to choose from."""
        return self

    @property
    def cpu(self) -> bool:
        return True

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> Dataset:
        return self._like(f(self._df), None)


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's statistics say; where they say nothing, rows times the usual size of their types."""
    total = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return total if total < 1 << 60 else df.count() * int(df._jdf.schema().defaultSize())


class DataFrameIter:
    """Partitions one after another as pandas frames. Each is a job over that partition alone, when it is asked for."""

    def __init__(self, dataset: Dataset, columns: list[str] | None, indices: list[int] | None, shuffle: bool, seed: int, epochs: int):
        self.df = dataset.to_df(columns)
        self.indices = list(range(dataset.npartitions)) if indices is None else list(indices)
        self.chosen = indices is not None
        self.shuffle, self.seed, self.epochs = shuffle, seed, epochs
        self.dataset = dataset

    def __len__(self) -> int:
        """Rows in all epochs."""
        lens = self.dataset.partition_lens if self.chosen else None
        rows = sum(lens[i] for i in self.indices) if lens is not None else self.dataset.num_rows
        return rows * self.epochs

    def __iter__(self) -> Iterator:
        blobs = self.df.mapInArrow(_packed, "rows binary").rdd
        for epoch in range(self.epochs):
            order = list(self.indices)
            if self.shuffle:
                random.Random(self.seed + epoch).shuffle(order)
            for i in order:
                found = self.df.sparkSession.sparkContext.runJob(blobs, lambda rows: [bytes(r[0]) for r in rows], [i])
                if found:
                    yield pa.Table.from_batches([b for x in found for b in pa.ipc.open_stream(x)]).to_pandas()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches as rows, one each."""
    for batch in batches:
        if len(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])


def _blocks(files: int, ranges: int) -> Callable:
    """Arrow batches of a range as rows, with their place in it and the file that gets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, packed in enumerate(_packed(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (part * files // ranges, part, i)] + [packed.column(0)], ["file", "range", "block", "rows"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            yield from pa.ipc.open_stream(x.as_buffer())


def own_session(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session with the settings of another and some of its own, which leaves the other as it is."""
    out = spark.newSession()
    for r in spark.sql("SET").collect():
        if r["key"].startswith("spark.sql.") and spark.conf.isModifiable(r["key"]):
            out.conf.set(r["key"], r["value"])
    for k, v in conf.items():
        out.conf.set(k, v)
    return out


def _within(file: str, path: str) -> bool:
    """Whether a file is a path or in it, however many slashes its scheme has."""
    a, b = (re.sub(r"^([a-z0-9]+):/+", r"\1:/", unquote(x)) for x in (file, path))
    return a == b or a.startswith(b + "/")


def _bytes(x: Any) -> int | None:
    """Bytes of a number, or of text such as 128MB."""
    if x is None or isinstance(x, int | float):
        return None if x is None else int(x)
    text = str(x).strip().upper().removesuffix("B")
    unit = {"K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "KI": 2**10, "MI": 2**20, "GI": 2**30, "TI": 2**40}
    for u in sorted(unit, key=len, reverse=True):
        if text.endswith(u):
            return int(float(text.removesuffix(u)) * unit[u])
    return int(float(text))
