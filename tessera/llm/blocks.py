"""Blocks of documents: texts that meet in one task, as compressed Arrow batches, with what others send for them.

A block is a partition of a hash partitioning; documents are dealt to blocks by a hash of their row, so a block holds
about the same share of texts whatever the sources are, and there are as many blocks as the bytes of the texts ask for. Within one plan, Spark reuses the exchange of the blocks for
every step that needs them, so that texts travel once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lean import lean

#: Bytes of texts that a task gathers before it deals them to blocks.
GATHER = 32_000_000
#: Bytes of texts in a block, about, at any size of the corpus.
BLOCK_BYTES = 32_000_000
#: Blocks whose entries (words, symbols, windows) a part of a table of them holds at most, together.
BLOCKS_A_PART = 8


def n_blocks(docs: DataFrame) -> int:
    """By the bytes of all texts; at least as many as there are shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))


def n_parts(spark: SparkSession, blocks: int) -> int:
    """Parts of a table of entries, such that a part does not grow with the corpus; at least the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // BLOCKS_A_PART))


def block_keys(spark: SparkSession, n: int) -> list[int]:
    """Per partition of a hash partitioning of n, a number that goes to it, so that blocks are dealt evenly."""
    most = 24 * n + 200
    found = spark.range(most).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    keys = {r["at"]: r["id"] for r in found}
    return [keys.get(i, most + i) for i in range(n)]


def shrunk(**columns: pa.Array) -> bytes:
    return _stream(pa.table(columns))


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _pack(keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GATHER:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        block = rows.column(0).to_numpy()
        rows = rows.drop_columns([rows.column_names[0]])
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            part = rows.take(pa.array(order[a:b])).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([keys[block[order[a]]]], pa.int32()), pa.array([_stream(part)], pa.binary())], ["k", "blob"])

    return lean(run)


def deal(docs: DataFrame, keep: list[str], names: list[str], keys: list[int]) -> DataFrame:
    """(k, blob): compressed rows of block k, with the columns named in `keep`, as `names`, and text."""
    n = len(keys)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in keep if not isinstance(docs.schema[c].dataType, T.MapType)), "text")
    rows = docs.select(F.pmod(row, F.lit(n)).cast("int").alias("b"), *(F.col(f"`{c}`").alias(o) for c, o in zip(keep, names, strict=True)), F.col("text").alias("text"))
    return rows.mapInArrow(_pack(keys), "k int, blob binary").repartition(n, "k")
