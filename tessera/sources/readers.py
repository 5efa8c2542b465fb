"""Readers: from a path or an object in memory to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hex_to_int
from ..operators.base import quoted
from ..plans import dtypes as D
from .files import Files, natural

#: Hadoop and other reserved words of filters.
_OPS: dict[str, Callable[[Column, Any], Column]] = {
    "==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
    "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(),
}


def predicate(filters: list) -> Column:
    """[(column, op, value), ...] all hold; a list of such lists: all of any."""
    if not filters:
        return F.lit(True)
    groups = [filters] if isinstance(filters[0], tuple) else filters
    out = None
    for group in groups:
        both = None
        for name, op, *value in group:
            if op not in _OPS:
                raise ValueError(f"no such comparison: {op}")
            c = _OPS[op](quoted(name), value[0] if value else None)
            both = c if both is None else both & c
        out = both if out is None else out | both
    return out


def cast_columns(df: DataFrame, dtypes: dict[str, Any]) -> DataFrame:
    """Other types for columns; "hex" reads hexadecimal text as 32-bit numbers."""
    new = {}
    for name, kind in dtypes.items():
        if name not in df.columns:
            continue
        if kind == "hex":
            new[name] = hex_to_int(quoted(name))
        else:
            target = D.dtype(kind).to_spark
            new[name] = quoted(name).cast(target if target is not None else str(kind))
    return df.withColumns(new)


def detect_format(path: str) -> str:
    """parquet, csv or avro, by the suffix, ignoring that of compression."""
    name = str(path).lower()
    for end in (".gz", ".bz2", ".zst", ".snappy", ".lz4"):
        name = name.removesuffix(end) if not name.endswith(".snappy.parquet") else name
    for kind, suffixes in {"parquet": (".parquet", ".pq", ".parq"), "csv": (".csv", ".tsv"), "avro": (".avro",)}.items():
        if name.endswith(suffixes):
            return kind
    raise ValueError(f"the format of {path} cannot be told from its suffix; give engine")


def paths_of(source: Any) -> list[str]:
    paths = [source] if isinstance(source, str | Path) else list(source)
    return sorted(map(str, paths), key=natural)


def read_parquet(spark: SparkSession, paths: list[str], filters: list | None = None, **options: Any) -> DataFrame:
    """Schema sidecars beside the data do not disturb; hive folders become columns."""
    aggregate = options.pop("aggregate_files", None)
    df = spark.read.options(pathGlobFilter="*.parquet", **{k: v for k, v in options.items() if v is not None}).parquet(*paths)
    if filters:
        df = df.filter(predicate(filters))
    if aggregate is True:  # small files in partitions of the size that a scan's have
        total = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        df = df.coalesce(max(1, -(-total // size)))
    elif aggregate:
        df = df.repartition(quoted(aggregate))
    return df


def read_csv(spark: SparkSession, paths: list[str], names: list[str] | None = None, header: bool | int | None = None, sep: str = ",", schema: Any = None, **options: Any) -> DataFrame:
    """names: for files without a header line."""
    files = []
    for p in paths:
        f = Files(spark, p)
        files += [f"{p.rstrip('/')}/{n}" for n in f.list("*.csv*")] if f.is_dir() else [p]
    reader = spark.read.options(header=names is None and header is not False, sep=sep, **options)
    df = reader.schema(schema).csv(files) if schema is not None else reader.option("inferSchema", True).csv(files)
    return df.toDF(*names) if names else df


def read_avro(spark: SparkSession, paths: list[str], part_size: int | None = None, **options: Any) -> DataFrame:
    """By Spark's package where the session has it, else by the Python source."""
    if options:
        raise ValueError(f"Avro files are read without {sorted(options)}")
    from .avro import AvroDataSource

    try:
        if not part_size:
            return spark.read.format("avro").load(paths)
    except AnalysisException as e:
        if "AVRO" not in str(e).upper():
            raise
    spark.dataSource.register(AvroDataSource)
    out = None
    for p in paths:
        reader = spark.read.format("tessera_avro").option("path", p)
        df = (reader.option("part_size", part_size) if part_size else reader).load()
        out = df if out is None else out.unionByName(df)
    return out


def parquet_metadata(path: str) -> tuple[int, int, list[str]]:
    """Rows, row groups and column names of one file, from its footer."""
    import pyarrow.parquet as pq

    from .avro import open_file

    with open_file(path) as f:
        m = pq.ParquetFile(f).metadata
        return m.num_rows, m.num_row_groups, m.schema.to_arrow_schema().names


ENGINES: dict[str, Callable[..., DataFrame]] = {"parquet": read_parquet, "csv": read_csv, "avro": read_avro}


def register_engine(name: str, read: Callable[..., DataFrame]) -> None:
    """read(spark, paths, **options) -> DataFrame."""
    ENGINES[name] = read


def lookup_table(spark: SparkSession, path: str, cache: str = "memory", cats_only: bool = False, columns: list[str] | None = None, engine: str = "parquet") -> DataFrame:
    """A table that is read often. cache: memory, disk or none. cats_only: adds each row's number as `labels`."""
    from pyspark import StorageLevel

    df = ENGINES[engine](spark, [path])
    if columns:
        df = df.select(*map(quoted, columns))
    if cats_only:
        from ..functions.frames import ranked

        df = ranked(df.withColumn("__at", F.monotonically_increasing_id()), F.col("__at"), name="labels", start=0).drop("__at")
    level = {"memory": StorageLevel.MEMORY_AND_DISK, "device": StorageLevel.MEMORY_AND_DISK, "host": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}.get(cache)
    return df.persist(level) if level else df
