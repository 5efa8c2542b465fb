"""Statistics that follow a stream: aggregates that Spark keeps as state, and tables of what they were last.

Each micro-batch writes the groups that it changed to a folder of its own, which a retried batch writes anew, so the table
is exact whatever is tried again. What a group was last is an aggregation over the batches; `settle` puts batches that are
done together, so that the table stays as large as it has groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.base import quoted
from ..sources.files import Files

_BATCH = "__batch"


def follow(stream: DataFrame, keys: dict[str, Column], aggregates: dict[str, Column], path: str, checkpoint: str, watermark: tuple[str, str] | None = None, once: bool = True) -> StreamingQuery:
    """Keeps aggregates by keys up to date under path. watermark: a column of time and how late a row may be, for keys with
    a window of that time; older groups leave the state, and rows for them are dropped. once: all that is there now."""
    if not stream.isStreaming:
        raise ValueError("this is not a stream")
    rows = stream.withWatermark(*watermark) if watermark else stream
    grouped = rows.groupBy(*(c.alias(n) for n, c in keys.items())).agg(*(c.alias(n) for n, c in aggregates.items()))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{_BATCH}={number}")

    writer = grouped.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if once else writer).start()


def followed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What every group was last."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*keys, _BATCH)]
    last = df.groupBy(*map(quoted, keys)).agg(F.max_by(F.struct(*map(quoted, rest)), F.col(_BATCH)).alias("__last"))
    return last.select(*map(quoted, keys), *(F.col("__last")[c].alias(c) for c in rest))


def settle(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Puts all batches but the last one together in the folder of the newest of them, and says how many they were. Readers
    of the table see each group all the time: the new folder replaces one that it includes, before the others go."""
    files = Files(spark, path)
    numbers = sorted(int(n.split("=")[1]) for n in files.list(f"{_BATCH}=*"))[:-1]
    if len(numbers) < 2:
        return 0
    old = spark.read.option("basePath", path).parquet(*(f"{path}/{_BATCH}={n}" for n in numbers))
    rest = [c for c in old.columns if c not in (*keys, _BATCH)]
    last = old.groupBy(*map(quoted, keys)).agg(F.max_by(F.struct(*map(quoted, rest)), F.col(_BATCH)).alias("__last"))
    last.select(*map(quoted, keys), *(F.col("__last")[c].alias(c) for c in rest)).write.mode("overwrite").parquet(f"{path}/_settled")
    files.delete(f"{_BATCH}={numbers[-1]}")
    files.rename("_settled", f"{_BATCH}={numbers[-1]}")
    for n in numbers[:-1]:
        files.delete(f"{_BATCH}={n}")
    return len(numbers)


def codes(spark: SparkSession, path: str, column: str, count: str = "count") -> DataFrame:
    """value and code of a followed column: ranks by falling frequency, ties by value, as `FrequencyEncode` has them."""
    from ..functions.frames import ranked

    known = followed(spark, path, [column]).filter(quoted(column).isNotNull()).select(quoted(column).alias("value"), quoted(count).alias("n"))
    return ranked(known, F.desc("n"), F.asc("value"), name="code").select("value", "code")


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stream's aggregates as it is stored: key and value, each a struct."""
    return spark.read.format("statestore").load(checkpoint)
