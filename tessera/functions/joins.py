"""Full joins whose keys may have any number of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage

#: Rows of a side that a task pairs at a time; keys of more than TILE * TILE pairs are cut in tiles.
TILE = 2000
#: Pairs that a task makes, about.
PAIRS = 16_000_000


def full_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], null_safe: bool = True) -> DataFrame:
    """A full outer join of frames without a column name in common. Spark splits no key of such a join, and holds all pairs
    of a key. A key with many pairs has rows on both sides, so its part is an inner join: its rows are dealt to tiles, each
    left one with each right one. Nothing but keys of more than TILE * TILE pairs, of which there are fewer than rows /
    TILE, is sent to all executors."""
    hot = _hot(left, right, on, null_safe)
    if hot is None:
        return left.join(right, keys_equal(on, null_safe), "full")
    n = _parts(hot)
    a, b = (_told(df, hot, [pair[side] for pair in on], null_safe) for side, df in enumerate((left, right)))
    few, others = (x.filter("__h IS NULL").select(*df.columns) for x, df in ((a, left), (b, right)))
    rest = few.join(others, keys_equal(on, null_safe), "full")
    xs = _tiles(a, "__a", "__b", left.columns, "x").repartition(n, "__hx", "__ix", "__jx")
    ys = _tiles(b, "__b", "__a", right.columns, "y").repartition(n, "__hy", "__jy", "__iy")
    met = xs.join(ys, (F.col("__hx") == F.col("__hy")) & (F.col("__ix") == F.col("__jy")) & (F.col("__jx") == F.col("__iy")))
    return rest.unionByName(met.select(*left.columns, *right.columns))


def keys_equal(pairs: list[tuple[str, str]], null_safe: bool) -> Column:
    return reduce(lambda x, y: x & y, (F.col(p).eqNullSafe(F.col(q)) if null_safe else F.col(p) == F.col(q) for p, q in pairs))


def _hot(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], null_safe: bool) -> DataFrame | None:
    """__h, the key, __a and __b: tiles of each side, and __pairs, of keys with many pairs; None without any. Keys of two
    types are left alone: several of one side could equal one of the other."""
    if any(left.schema[p].dataType != right.schema[q].dataType for p, q in on):
        return None
    rows = [df.groupBy(*(F.col(pair[side]).alias(f"__{name}{i}") for i, pair in enumerate(on))).agg(F.count("*").alias(f"__n{name}")) for side, (name, df) in enumerate((("p", left), ("q", right)))]
    both = rows[0].join(rows[1], keys_equal([(f"__p{i}", f"__q{i}") for i in range(len(on))], null_safe))
    pairs = F.col("__np").cast("decimal(38,0)") * F.col("__nq")
    tiles = [F.ceil(F.col(n) / TILE).cast("int").alias(name) for n, name in (("__np", "__a"), ("__nq", "__b"))]
    found = both.filter(pairs > TILE * TILE).select(F.monotonically_increasing_id().alias("__h"), *(f"__p{i}" for i in range(len(on))), *tiles, pairs.cast("double").alias("__pairs"))
    found = cut_lineage(found)
    return None if found.isEmpty() else found


def _parts(hot: DataFrame) -> int:
    least = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(100_000, max(least, hot.agg(F.sum("__pairs")).first()[0] / PAIRS)))


def _told(df: DataFrame, hot: DataFrame, keys: list[str], null_safe: bool) -> DataFrame:
    """The rows with what is known of their key, if it is hot."""
    known = keys_equal([(k, f"__p{i}") for i, k in enumerate(keys)], null_safe)
    return df.join(F.broadcast(hot), known, "left")


def _tiles(df: DataFrame, own: str, others: str, columns: list[str], side: str) -> DataFrame:
    """Rows of hot keys, each in a tile of its side (__i) and once for each of the other's (__j). Which tile is stored, so
    that it is the same if a task is tried again; equal rows are spread."""
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(own)).cast("int")
    rows = cut_lineage(df.filter("__h IS NOT NULL").select(*columns, F.col("__h").alias(f"__h{side}"), dealt.alias(f"__i{side}"), F.col(others).alias("__others")))
    return rows.withColumn(f"__j{side}", F.explode(F.sequence(F.lit(0), F.col("__others") - 1))).drop("__others")
