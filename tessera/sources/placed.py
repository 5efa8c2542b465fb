"""Data that lie where they are needed: folders by keys, buckets, and counts that footers know."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import quoted
from .files import Files

BUCKETS = "_buckets.json"
#: Scans that a dataset of folders is read by at most; with more folders, a scan reads several.
SCANS = 256


def by_folders(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of a table in folders by keys, in at most n partitions, each of whole folders: a scan of some folders per
    partition, put side by side. The folders and their rows are known from names and footers, so no column is read for
    that; large folders are dealt out first."""
    n = max(1, min(n, SCANS))
    rows = df.groupBy(*map(quoted, keys)).count().collect()
    if not rows:
        return df.coalesce(1)
    groups: list[list] = [[] for _ in range(min(n, len(rows)))]
    weight = [0] * len(groups)
    for r in sorted(rows, key=lambda r: (-r["count"], str(tuple(r)))):
        i = weight.index(min(weight))
        groups[i].append(r)
        weight[i] += r["count"]
    # a scan that is left without folders keeps the union from zipping parts that are one partition each into one
    place = F.xxhash64(*map(quoted, keys))
    none = df.filter((place == 0) & (place == 1))
    return reduce(DataFrame.union, [none, *(df.filter(_any_of(keys, g)).coalesce(1) for g in groups)])


def _any_of(keys: list[str], rows: list) -> Column:
    """Conditions on folder columns only, by which a scan leaves other folders out."""
    if len(keys) == 1:
        c, values = quoted(keys[0]), [r[0] for r in rows]
        known = c.isin([v for v in values if v is not None])
        return known | c.isNull() if None in values else known
    each = (reduce(lambda a, b: a & b, (quoted(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, r, strict=False))) for r in rows)
    return reduce(lambda a, b: a | b, each)


def _table(path: str) -> str:
    return "tessera_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def write_buckets(df: DataFrame, path: str, keys: list[str], n: int, sort_by: list[str]) -> None:
    """Files of n buckets, one each, with a note beside them of how they were made."""
    spark = df.sparkSession
    files = Files(spark, path)
    where = files.fs.makeQualified(files.root).toString()
    spark.sql(f"DROP TABLE IF EXISTS {_table(where)}")
    placed = df.repartition(n, *map(quoted, keys))
    placed.write.format("parquet").mode("overwrite").option("path", where).bucketBy(n, *keys).sortBy(*sort_by).saveAsTable(_table(where))
    files.write(BUCKETS, json.dumps({"keys": keys, "buckets": n, "sort_by": sort_by, "schema": df.schema.simpleString()[7:-1]}))


def bucket_keys(spark: SparkSession, paths: list[str]) -> list[str]:
    files = Files(spark, paths[0])
    if len(paths) > 1 or not files.is_dir() or not files.exists(BUCKETS):
        return []
    return json.loads(files.read(BUCKETS))["keys"]


def bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table whose buckets Spark knows; other sessions than the writer's name it again."""
    files = Files(spark, path)
    where, note = files.fs.makeQualified(files.root).toString(), json.loads(files.read(BUCKETS))
    if not spark.catalog.tableExists(_table(where)):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(where).schema)
        by, order = (", ".join(f"`{k}`" for k in note[x]) for x in ("keys", "sort_by"))
        spark.sql(f"CREATE TABLE {_table(where)} ({cols}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {note['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(_table(where))


def footer_counts(spark: SparkSession, paths: list[str], by: list[str] | None = None) -> DataFrame:
    """count: rows of Parquet files, from their footers; by: columns of folders to count by. The aggregate is pushed to
    the scan, whose tasks read footers only."""
    from .dataset import own_session

    own = own_session(spark, {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"})
    df = own.read.option("pathGlobFilter", "*.parquet").parquet(*paths)
    return df.groupBy(*map(quoted, by)).agg(F.count("*").alias("count")) if by else df.agg(F.count("*").alias("count"))


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, rows, groups, largest (bytes of the largest row group), bytes (of all) and schema of Parquet files, whose
    footers are read by tasks."""
    import pyarrow as pa

    def read(batches):
        import pyarrow.parquet as pq

        from tessera.sources.avro import open_file

        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with open_file(path) as stream:
                    file = pq.ParquetFile(stream)
                    m = file.metadata
                    size = [m.row_group(i).total_byte_size for i in range(m.num_row_groups)]
                    found.append((path, m.num_rows, len(size), max(size, default=0), sum(size), str(file.schema_arrow.remove_metadata())))
            names = ["path", "rows", "groups", "largest", "bytes", "schema"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)

    named = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)), "path")
    return named.mapInArrow(read, "path string, rows long, groups long, largest long, bytes long, schema string")
