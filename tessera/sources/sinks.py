"""Writers with control over files: their number, names, order, row groups, and the sidecars beside them."""

from __future__ import annotations

import json
import re
import uuid
import warnings
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import row_hash
from ..operators.base import quoted
from ..plans import schema_io
from ..plans.schema import Schema
from .avro import create_file, open_file
from .files import Files
from .readers import cast_columns

SCHEMA_JSON = ".schema/schema.json"
SCHEMA_TEXT = "schema.pbtxt"
FILE_LIST, FILE_META = "_file_list.txt", "_metadata.json"


class Shuffle(Enum):
    PER_PARTITION = "per_partition"
    PER_WORKER = "per_worker"
    FULL = "full"


def shuffle_of(shuffle: Any) -> Shuffle | None:
    if shuffle is None or shuffle is False:
        return None
    if shuffle is True:
        warnings.warn("shuffle=True is deprecated; it stands for Shuffle.PER_WORKER", DeprecationWarning, stacklevel=3)
        return Shuffle.PER_WORKER
    if not isinstance(shuffle, Shuffle):
        raise ValueError(f"shuffle is one of {list(Shuffle)}, not {shuffle!r}")
    if shuffle == Shuffle.FULL:
        raise ValueError("Shuffle.FULL is not offered here; sort by a hash of the rows for that")
    return shuffle


def shuffled_for_writing(df: DataFrame, shuffle: Shuffle | None, seed: int = 0) -> DataFrame:
    """Order by a hash of row and seed in each partition, after an exchange for PER_WORKER; a retried task writes the same."""
    if shuffle is None:
        return df
    key = row_hash(df, seed)
    if shuffle == Shuffle.PER_WORKER:
        workers = max(1, df.sparkSession.sparkContext.defaultParallelism)
        df = df.repartition(workers, row_hash(df, seed + 1))
    return df.sortWithinPartitions(key)


def partition_count(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def _writer(df: DataFrame, row_group_size: int | None, metadata_file: bool, compression: str, row_group_bytes: int | None = None) -> Any:
    w = df.write.option("compression", compression)
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    if row_group_size:
        w = w.option("parquet.block.row.count.limit", str(row_group_size))
    if metadata_file:
        w = w.option("parquet.summary.metadata.level", "ALL")
    return w


def _rename(files: Files, names: dict[int, str]) -> list[str]:
    """Part files by the id of their partition to given names."""
    done = []
    for part in files.list("part-*"):
        i = int(re.match(r"part-(\d+)", part)[1])
        if i in names:
            if "/" in names[i]:
                files.make(names[i].rsplit("/", 1)[0])
            files.rename(part, names[i])
            done.append(names[i])
    return done


def _own_names(paths: list[str]) -> list[str]:
    """What files are called, without their suffix; files of one name in several folders keep their folders, from where
    these part."""
    bare = [re.sub(r"\.[^./]+$", "", p) for p in paths]
    short = [p.rsplit("/", 1)[-1] for p in bare]
    folders = [p.split("/")[:-1] for p, n in zip(bare, short, strict=True) if short.count(n) > 1]
    same = 0
    while folders and all(len(f) > same and f[same] == folders[0][same] for f in folders):
        same += 1
    return ["/".join(p.split("/")[same:]) if short.count(n) > 1 else n for p, n in zip(bare, short, strict=True)]


def to_parquet(
    df: DataFrame, path: str, schema: Schema, *, shuffle: Any = None, preserve_files: bool = False, output_files: Any = None, out_files_per_proc: int | None = None,
    row_group_size: int | None = None, dtypes: dict | None = None, cats: list | None = None, conts: list | None = None, labels: list | None = None, suffix: str = ".parquet",
    partition_on: list[str] | str | None = None, method: str | None = None, write_metadata_file: bool = False, write_schema_text: bool = False, keyset: bool = False,
    source_files: Column | None = None, compression: str = "none", mode: str = "overwrite", seed: int = 0, row_group_bytes: int | None = None,
) -> None:
    partition_on = [partition_on] if isinstance(partition_on, str) else partition_on
    if partition_on and (output_files is not None or preserve_files or out_files_per_proc):
        raise ValueError("partition_on goes without output_files, preserve_files and out_files_per_proc")
    if preserve_files and output_files is not None:
        raise ValueError("preserve_files goes without output_files")
    if method not in (None, "subgraph", "worker"):
        raise ValueError(f"no such method: {method}")
    if partition_on and len(partition_on) >= len(df.columns):
        raise ValueError("partition_on leaves no column to write")
    how = shuffle_of(shuffle)
    if dtypes:
        df = cast_columns(df, dtypes)
        written = Schema.from_spark(df.schema)
        schema = Schema(c.with_dtype(written[c.name].dtype.without_shape) if c.name in dtypes and c.name in written else c for c in schema)
    files = Files(df.sparkSession, path)
    if output_files is not None or out_files_per_proc:
        if output_files is None:
            output_files = out_files_per_proc * max(1, df.sparkSession.sparkContext.defaultParallelism)
        _numbered(df, path, output_files, how, seed, row_group_size, write_metadata_file, compression, mode, suffix)
    elif preserve_files:
        if source_files is None:
            raise ValueError("preserve_files needs a dataset that was read from files")
        named = df.withColumn("__file", source_files)
        found = sorted(r[0] for r in named.select("__file").distinct().collect())
        names = {i: n.removesuffix(suffix) + suffix for i, n in enumerate(_own_names(found))}
        index = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(found)], "__file string, __id int")
        placed = named.join(F.broadcast(index), "__file").repartitionById(max(1, len(found)), F.col("__id")).drop("__file", "__id", "__path")
        _writer(shuffled_for_writing(placed, Shuffle.PER_PARTITION if how else None, seed), row_group_size, write_metadata_file, compression).mode(mode).parquet(path)
        _rename(files, names)
    elif partition_on:
        # large keys are split among tasks, small ones put together
        spread = df.hint("rebalance", *map(quoted, partition_on)) if method != "worker" else df
        _writer(shuffled_for_writing(spread, Shuffle.PER_PARTITION if how else None, seed), row_group_size, write_metadata_file, compression).mode(mode).partitionBy(*partition_on).parquet(path)
    else:
        if method == "worker":
            df = df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))
        _writer(shuffled_for_writing(df, how, seed), row_group_size, write_metadata_file, compression, row_group_bytes).mode(mode).parquet(path)
        _rename(files, {int(re.match(r"part-(\d+)", p)[1]): f"part_{i}{suffix}" for i, p in enumerate(files.list("part-*"))})
    write_sidecars(files, schema, cats, conts, labels, write_schema_text, keyset)


def _numbered(df, path, output_files, how, seed, row_group_size, metadata_file, compression, mode, suffix) -> None:
    """Files by number, names, or a dict from names to the partitions that they get; partitions in no file are left out."""
    n = partition_count(df)
    part = F.spark_partition_id()
    if isinstance(output_files, dict):
        groups = [([k] if isinstance(k, str) else list(k), list(v)) for k, v in output_files.items()]
        names, target, first = [], F.lit(None).cast("int"), 0
        for files_, ids in groups:
            for j, i in enumerate(sorted(ids)):
                target = F.when(part == i, F.lit(first + j * len(files_) // max(1, len(ids)))).otherwise(target)
            names += files_
            first += len(files_)
    else:
        names = [f"part_{i}{suffix}" for i in range(output_files)] if isinstance(output_files, int) else list(output_files)
        if n < len(names):
            warnings.warn(f"{len(names)} files are asked of {n} partitions; rows are dealt out anew", stacklevel=3)
            target = F.pmod(row_hash(df, seed), F.lit(len(names))).cast("int")
        else:
            target = F.floor(part * F.lit(len(names)) / F.lit(n)).cast("int")
    placed = df.withColumn("__to", target).filter("__to IS NOT NULL").repartitionById(max(1, len(names)), F.col("__to")).drop("__to")
    _writer(shuffled_for_writing(placed, Shuffle.PER_PARTITION if how else None, seed), row_group_size, metadata_file, compression).mode(mode).parquet(path)
    _rename(Files(df.sparkSession, path), {i: x if x.endswith(suffix) else x + suffix for i, x in enumerate(names)})


def write_sidecars(files: Files, schema: Schema, cats: list | None, conts: list | None, labels: list | None, text: bool, keyset: bool) -> None:
    """After the data are there: the schema, the list of files, and which columns are what."""
    files.write(SCHEMA_JSON, schema_io.to_json(schema))
    if text:
        files.write(SCHEMA_TEXT, schema_io.to_text(schema))
    if cats is not None or conts is not None or labels is not None:
        names = [n for n in files.sizes() if n.endswith((".parquet", ".bin"))]
        files.write(FILE_LIST, f"{len(names)}\n" + "".join(f"{files.at(n).toString()}\n" for n in names))
        at = {c: i for i, c in enumerate(schema.column_names)}
        rows = _rows(files, [n for n in names if n.endswith(".parquet")])
        stats = [{"file_name": n, "num_rows": rows.get(n)} for n in names]
        kinds = {kind: [{"col_name": c, "index": at.get(c, -1)} for c in cols or []] for kind, cols in (("cats", cats), ("conts", conts), ("labels", labels))}
        files.write(FILE_META, json.dumps({"file_stats": stats, **kinds}))
    if keyset:
        files.write("_keyset", keyset_bytes(schema))


def _rows(files: Files, names: list[str]) -> dict[str, int]:
    """Rows of Parquet files, by one job."""
    from .placed import footers

    at = {files.at(n).toString().removeprefix("file:"): n for n in names}
    return {at[r["path"]]: r["rows"] for r in footers(files.spark, list(at)).select("path", "rows").collect()} if at else {}


def keyset_bytes(schema: Schema) -> bytes:
    """For each column with an embedding's cardinality: the numbers below it, four bytes each, big end first."""
    import numpy as np

    return b"".join(np.arange(int(c.properties["embedding_sizes"]["cardinality"]) + 1, dtype=">u4").tobytes() for c in schema if "embedding_sizes" in c.properties)


def find_schema(spark: Any, path: str) -> Schema | None:
    """The schema beside the data, or in the folder above (as with hive folders)."""
    files = Files(spark, path)
    for folder in (path, files.parent()):
        f = Files(spark, folder) if folder else None
        if f is not None and f.exists(SCHEMA_JSON):
            return schema_io.from_json(f.read(SCHEMA_JSON).decode())
    for folder in (path, files.parent()):
        f = Files(spark, folder) if folder else None
        if f is not None and f.exists(SCHEMA_TEXT):
            return schema_io.from_text(f.read(SCHEMA_TEXT).decode())
    return None


# other formats

#: Bytes that are copied from file to file at a time.
COPY = 1 << 22
#: Fixed values of the binary format: eight 64-bit numbers in front (0, rows, labels, numbers, keys, 0, 0, 0).
HEADER = 8


def row_bytes(labels: int, conts: int, cats: int) -> Any:
    """A row: labels and numbers as 32-bit floats; then for each key column how many there are (1) and the key."""
    import numpy as np

    return np.dtype([("labels", "<f4", (labels,)), ("conts", "<f4", (conts,)), ("cats", [("n", "<i4"), ("key", "<u4")], (cats,))])


def to_binary(df: DataFrame, path: str, cats: list[str], conts: list[str], labels: list[str], schema: Schema, shuffle: Any = None, seed: int = 0) -> None:
    """One file of fixed-size rows per partition, written where it is made through Arrow's file systems."""
    import numpy as np
    import pyarrow as pa

    df = shuffled_for_writing(df, shuffle_of(shuffle), seed)
    kind = row_bytes(len(labels), len(conts), len(cats))
    target = Files(df.sparkSession, path)
    if target.exists():
        target.delete("")
    target.make()
    root = target.fs.makeQualified(target.root).toString()

    def write(batches):
        import shutil
        import tempfile

        from pyspark import TaskContext

        context = TaskContext.get()
        part, body, rows = context.partitionId(), tempfile.TemporaryFile(), 0  # the header has the number of rows
        name = f"_{part}-{context.taskAttemptId()}"
        for b in batches:
            a = np.zeros(len(b), kind)
            for field, names in (("labels", labels), ("conts", conts)):
                for i, c in enumerate(names):
                    a[field][:, i] = b.column(c).to_numpy(zero_copy_only=False)
            a["cats"]["n"] = 1
            for i, c in enumerate(cats):
                a["cats"]["key"][:, i] = b.column(c).to_numpy(zero_copy_only=False)
            body.write(a.tobytes())
            rows += len(b)
        if rows:
            with create_file(f"{root}/{name}") as out:
                out.write(np.array([0, rows, len(labels), len(conts), len(cats), 0, 0, 0], "<i8").tobytes())
                body.seek(0)
                shutil.copyfileobj(body, out, COPY)
        body.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([name])], ["part", "rows", "name"])

    columns = [*labels, *conts, *cats]
    # a task's file gets its name when the job is done; what other attempts have left goes
    for r in df.select(*map(quoted, columns)).mapInArrow(write, "part int, rows long, name string").collect():
        if r["rows"]:
            target.rename(r["name"], f"{r['part']}.bin")
    for name in target.list("_*-*"):
        target.delete(name)
    write_sidecars(target, schema.select_by_name(columns), cats, conts, labels, False, False)


#: Types of numbers that can be a matrix without objects.
MATRIX = {"byte": "i1", "short": "i2", "integer": "i4", "long": "i8", "float": "f4", "double": "f8", "boolean": "?"}


def to_npy(df: DataFrame, path: str, append: bool = False) -> None:
    """One matrix in a file; list columns become columns. Tasks write the rows of their partitions to the shared folder,
    and the driver streams them one after another behind the header. Only columns that make objects, which the format
    pickles as a whole, come to the driver; they cannot be appended."""
    import shutil

    import numpy as np
    import pyarrow as pa

    from ..functions.frames import checkpoint_folder
    from ..functions.lists import flatten_lists

    kinds = [f for f in df.schema.fields if not isinstance(f.dataType, T.NumericType | T.BooleanType | T.ArrayType)]
    if append and kinds:
        raise TypeError(f"columns {[f.name for f in kinds]} make objects, which cannot be appended")
    flat = flatten_lists(df)
    if flat.filter(" OR ".join(f"`{c}` IS NULL" for c in flat.columns)).limit(1).count():
        raise ValueError("null values cannot be written to an npy file")
    if not append and any(f.dataType.typeName() not in MATRIX for f in flat.schema.fields):
        table = flat.toArrow()
        with create_file(path) as out:
            np.save(out, np.stack([table[c].to_numpy() for c in table.column_names], 1), allow_pickle=bool(kinds))
        return
    kind = np.result_type(*(np.dtype(MATRIX[f.dataType.typeName()]) for f in flat.schema.fields))
    parts = Files(df.sparkSession, f"{checkpoint_folder(df.sparkSession)}/npy-{uuid.uuid4().hex}")
    parts.make()
    root = parts.fs.makeQualified(parts.root).toString()

    def write(batches):
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), 0
        with create_file(f"{root}/{part}.part") as out:
            for b in batches:
                out.write(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(kind).tobytes())
                rows += len(b)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.int64())], ["part", "rows"])

    try:
        made = sorted((r["part"], r["rows"]) for r in flat.mapInArrow(write, "part int, rows long").collect())
        with create_file(path) as out:
            shape = (sum(n for _, n in made), len(flat.columns))
            np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape})
            for part, _ in made:
                with open_file(f"{root}/{part}.part") as one:
                    shutil.copyfileobj(one, out, COPY)
    finally:
        parts.delete("")
