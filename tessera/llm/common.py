"""What the operators of this subpackage share: columns, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these.
GAP = r"[\x20\x09-\x0D]+"
#: Rows of at most a few dozen bytes that may be sent to every executor.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster names it in spark.checkpoint.dir; only where that is
    unset, as in tests on one machine, a local one is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
        folder = sc.getCheckpointDir()
    return folder


_made: list[str] = []


@atexit.register
def _remove_stored() -> None:
    """Tables are of use as long as some result may still be computed, so they go when the driver ends, if its session
    lives until then; otherwise the folder is the cluster's to clean."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    for path in _made:
        _delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives the loss of executors, is computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of `stored` that no frame in use is computed from any more."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path in _made:
            _made.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored side of a join for broadcasting if it has at most `most` rows; otherwise it is joined by a
    shuffle, of which adaptive execution splits skewed partitions."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df.hint("merge")


def own_names(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for helper columns that do not clash with the columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        out[name] = own
    return out
