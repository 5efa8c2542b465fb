"""Joins of intervals, top rows per key, and ranges of keys of equal weight."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.base import quoted
from . import frames

SALTS = 64
#: Points of the quantile sketch of keys in each part: the error of a part's size is about one over this.
POINTS = 40
#: A key is hot, and may be split, from this share of a part's rows.
HOT = 0.05


def overlap_join(left: DataFrame, right: DataFrame, start: tuple[str, str], end: tuple[str, str], by: list[tuple[str, str]] | None = None, suffix: str = "_right") -> DataFrame:
    """Pairs of rows whose closed intervals of whole numbers overlap, within equal keys. Columns of right with names of left
    get the suffix. Intervals with a null end or that end before they start overlap nothing; null keys match nothing.

    An interval is put in the cells that it touches of a grid as coarse as it is long, which are two at most; grids double
    in width. Two intervals meet on the coarser of their grids, in the one cell where the later of them starts, so every
    pair is found once, and a long interval costs as many rows as there are grids in use on the other side, not as it has
    length."""
    by = by or []
    l = _gridded(left, start[0], end[0], [k for k, _ in by], "l")  # noqa: E741
    r = _gridded(right, start[1], end[1], [k for _, k in by], "r")
    used = [[x[0] for x in d.select(f"{s}_g").distinct().orderBy(f"{s}_g").collect()] for d, s in ((l, "l"), (r, "r"))]
    a, b = _cells(l, "l", used[1]), _cells(r, "r", used[0])
    cell = F.call_function("shiftright", F.greatest("l_s", "r_s"), F.col("l_at"))
    met = [F.col("l_at") == F.col("r_at"), F.col("l_cell") == F.col("r_cell"), *(F.col(f"l_k{i}") == F.col(f"r_k{i}") for i in range(len(by)))]
    met += [F.col("l_s") <= F.col("r_e"), F.col("r_s") <= F.col("l_e"), F.greatest("l_g", "r_g") == F.col("l_at"), cell == F.col("l_cell")]
    cond = met[0]
    for x in met[1:]:
        cond &= x
    names = [c + suffix if c in left.columns else c for c in right.columns]
    out = a.join(b, cond)
    return out.select(*(F.col(f"l_row.c{i}").alias(c) for i, c in enumerate(left.columns)), *(F.col(f"r_row.c{i}").alias(c) for i, c in enumerate(names)))


def _gridded(df: DataFrame, start: str, end: str, keys: list[str], side: str) -> DataFrame:
    """row, keys, s, e and g, the grid: its cells have a width of 2 ** g, more than the interval's length."""
    row = F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)))
    s, e = quoted(start).cast("long"), quoted(end).cast("long")
    rows = df.select(row.alias(f"{side}_row"), *(quoted(k).alias(f"{side}_k{i}") for i, k in enumerate(keys)), s.alias(f"{side}_s"), e.alias(f"{side}_e"))
    length = F.col(f"{side}_e") - F.col(f"{side}_s")
    return rows.filter(length >= 0).withColumn(f"{side}_g", F.length(F.bin(F.greatest(length, F.lit(1)))).cast("int"))


def _cells(df: DataFrame, side: str, other: list[int]) -> DataFrame:
    """A row for each cell in which an interval can meet those of the other side's grids."""
    theirs = F.array(*map(F.lit, other)).cast("array<int>")
    at = F.array_distinct(F.transform(theirs, lambda g: F.greatest(g, F.col(f"{side}_g"))))
    out = df.select("*", F.explode(at).alias(f"{side}_at"))
    ends = (F.call_function("shiftright", F.col(f"{side}_{x}"), F.col(f"{side}_at")) for x in "se")
    return out.select("*", F.explode(F.sequence(*ends)).alias(f"{side}_cell"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in an order. Each part of a key gives at most k rows, first within tasks, then within
    `SALTS` parts by a hash of the row, then all; a hot key is never sorted whole."""
    name = "__place"
    while name in df.columns:
        name += "_"
    salt = F.pmod(frames.row_hash(df), F.lit(SALTS))
    out = df.withColumn(f"{name}s", salt)
    for more in ([f"{name}s"], []):
        w = W.partitionBy(*map(quoted, keys), *more).orderBy(*order)
        out = out.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out.drop(name, f"{name}s")


def weighted_parts(df: DataFrame, key: str, n: int) -> tuple[DataFrame, list[Any]]:
    """The rows dealt to n partitions, as ranges of a key with about equal numbers of rows, and the keys (as whole numbers
    of days or microseconds for dates and times) that are split among several, whose results need a merge.

    Both sketches are mergeable aggregates of fixed size, so no key is shuffled: one keeps frequent keys, of which those
    with `HOT` of a part are counted exactly, one the ranks of the others. On a line in the order of the key, with frequent
    keys as long as they have rows, n equal pieces are cut: rows of a frequent key go to the pieces that it lies on by their
    hash, all others with their key. Null keys come first and are split alike. The driver holds the frequent keys, at most
    n / `HOT`, and `POINTS` * n ranks."""
    kind = df.schema[key].dataType.simpleString()
    numbers = {"timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp")), "date": F.unix_date}
    whole = kind in ("tinyint", "smallint", "int", "bigint", *numbers)
    value = numbers.get(kind, lambda c: c)(quoted(key)).cast("long" if whole else "double")
    x = df.select(value.alias("x"))
    total, nulls = x.agg(F.count("*"), F.count_if(F.col("x").isNull())).first()
    known = x.filter("x IS NOT NULL")
    hot = _frequent(known, max(1, math.ceil(HOT * total / n)), n)
    rest = known.filter(~F.col("x").isin(list(hot))) if hot else known
    left = total - nulls - sum(hot.values())
    cuts: list = []
    if left:
        sort, steps = "bigint" if whole else "double", POINTS * n
        sketch = rest.agg(F.expr(f"kll_sketch_agg_{sort}(x, {min(65535, max(200, 128 * n))})").alias("s"))
        ranks = ", ".join(f"{i / steps!r}D" for i in range(1, steps + 1))
        cuts = list(sketch.select(F.expr(f"kll_sketch_get_quantile_{sort}(s, array({ranks}))")).first()[0])
    cut_at, hot_at = np.array(cuts), np.array(sorted(hot))
    rank_at = np.arange(len(cuts) + 1) * (left / max(1, len(cuts)))
    weight = np.array([hot[h] for h in sorted(hot)], float)
    before = np.concatenate([[0.0], np.cumsum(weight)])
    begin = nulls + rank_at[np.searchsorted(cut_at, hot_at)] + before[:-1] if hot else np.zeros(0)
    size, none_weight = max(total / n, 1e-9), float(nulls)

    @F.pandas_udf("int")
    def part(x: pd.Series, u: pd.Series) -> pd.Series:
        none, chance = x.isna().to_numpy(), u.to_numpy()
        v = x.fillna(0).to_numpy()
        at = none_weight + rank_at[np.searchsorted(cut_at, v)]
        if len(hot_at):
            i = np.searchsorted(hot_at, v)
            j = np.minimum(i, len(hot_at) - 1)
            at = np.where(hot_at[j] == v, begin[j] + chance * weight[j], at + before[i])
        return pd.Series(np.clip(np.where(none, chance * none_weight, at) / size, 0, n - 1).astype(np.int32))

    # rows of a partition take turns, in an order that a task tried again has too, so that equal rows are spread evenly
    name = "__turn"
    while name in df.columns:
        name += "_"
    line = df.sortWithinPartitions(frames.row_hash(df, 77)).withColumn(name, F.monotonically_increasing_id())
    turn = F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) * F.lit(0.6180339887498949) + F.shiftright(name, 33) * F.lit(0.7548776662466927)
    split = [h for h, b, w in zip(sorted(hot), begin, weight, strict=True) if math.floor((b + w - 1) / size) > math.floor(b / size)]
    return line.repartitionById(n, part(value, turn - F.floor(turn))).drop(name), split


def _frequent(x: DataFrame, share: int, n: int) -> dict[Any, int]:
    """Counts of the values that at least `share` rows have. The sketch keeps more items than can have that, and loses none
    of them; what it names is counted."""
    most = math.ceil(2 * n / HOT)
    named = x.agg(F.expr(f"approx_top_k(x, {most}, {min(1_000_000, 8 * most)})").alias("found")).first()["found"]
    names = [r["item"] for r in named if r["count"] >= share]
    if not names:
        return {}
    counted = x.filter(F.col("x").isin(names)).groupBy("x").count().filter(F.col("count") >= share)
    return {r["x"]: r["count"] for r in counted.collect()}
