"""Ordered functions per key whose rows may be more than a task can hold.

`Segments` cuts a frame in ranges of (keys, order), so that a large key spans several ranges and small keys share one. A
function is computed within each range by a window, and what a range's first key brings along from the ranges before it (or
its last key from those after it) is carried over: a range tells the driver only about its two outer keys, so what is
collected has a row per range. No task holds more than a range, whatever the keys are.

Defined cases: a null key is a key, and null orders come first; rows that are equal in keys and order stand in an order by
hash of the row, so that ranges can split them; an empty frame stays empty; columns of any name may be there."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.base import quoted
from . import frames

#: Rows that a shift may carry over from one range to the next; longer ones join rows by number.
CARRIED = 1000


class Segments:
    """Rows of df in order within keys. Functions return a column name; `frame` gives the rows with columns asked for."""

    def __init__(self, df: DataFrame, keys: list[str] | None, order: list[str], descending: bool = False):
        self.columns, self.made, self.descending, self.tied = df.columns, {}, descending, None
        keys = keys or []
        row = F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)))
        at = lambda c: F.col(f"row.c{df.columns.index(c)}")
        key = F.struct(*(at(c).alias(f"k{i}") for i, c in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))
        value = F.struct(*(at(c).alias(f"o{i}") for i, c in enumerate(order)))
        rows = df.select(row.alias("row"), frames.row_hash(df).alias("h")).select("row", "h", key.alias("k"), value.alias("o"))
        by = [F.col("k").asc(), F.col("o").desc() if descending else F.col("o").asc(), F.col("h").asc()]
        self.line, _ = frames._in_order(rows, tuple(by), {})
        self.line = self.line.drop("h").withColumnsRenamed({"__part": "part", "__i": "i"})
        self.base, self.local = self.line, W.partitionBy("part", "k").orderBy("i")
        self.ends = self._edges(n=F.count("*"))
        self.place = dict(zip(self.columns, (f"row.c{i}" for i in range(len(self.columns))), strict=True))

    def _column(self, name: str) -> Column:
        return F.col(name) if name in self.made else F.col(self.place[name])

    def _kind(self, name: str) -> T.DataType:
        return self.line.select(self._column(name).alias("x")).schema["x"].dataType

    def _add(self, name: str, column: Column) -> str:
        self.line = self.line.withColumn(name, column)
        self.made[name] = True
        return name

    def _from(self, column: str) -> DataFrame:
        """The rows that have a column: those that were stored, if it was not made here."""
        return self.line if column in self.made else self.base

    def _edges(self, rows: DataFrame | None = None, **what: Column) -> list[tuple[int, Any, Any, int]]:
        """Per range in order: (part, first, last, keys), of its first and its last key, each with what is asked for."""
        rows = self.base if rows is None else rows
        each = rows.groupBy("part", "k").agg(F.min("i").alias("a"), F.max("i").alias("b"), *(c.alias(n) for n, c in what.items()))
        told = F.struct("k", *what)
        ends = each.groupBy("part").agg(F.min_by(told, "a").alias("first"), F.max_by(told, "b").alias("last"), F.count("*").alias("keys"))
        return [(r["part"], r["first"], r["last"], r["keys"]) for r in ends.orderBy("part").collect()]

    def _carry(self, edges: list, start: Any, step: Callable[[Any, Any], Any], back: bool = False) -> dict[int, Any]:
        """Per range, what its first key brings from earlier ranges (back: its last key from later ones)."""
        key, held, out = None, start, {}
        for part, first, last, keys in reversed(edges) if back else edges:
            near, far = (last, first) if back else (first, last)
            if key is not None and _same(near["k"], key):
                out[part] = held
            else:
                held = start
            held = step(held, near) if keys == 1 else step(start, far)
            key = far["k"]
        return out

    def _join(self, carried: dict[int, Any], name: str, kind: T.DataType | str, back: bool = False) -> Column:
        """A column with what is carried, for the rows of the key that it is for, else null."""
        kind = T.LongType() if kind == "long" else kind
        fields = [T.StructField("__p", T.LongType()), T.StructField("__e", self.base.schema["k"].dataType), T.StructField(name, kind)]
        rows = [(part, (last if back else first)["k"], carried[part]) for part, first, last, _ in self.ends if part in carried]
        outer = self.line.sparkSession.createDataFrame(rows, T.StructType(fields))
        held = self.line.join(F.broadcast(outer), (F.col("part") == F.col("__p")) & F.col("k").eqNullSafe(F.col("__e")), "left")
        self.line = held.drop("__p", "__e")
        return F.col(name)

    # functions
    def number(self, name: str = "number") -> str:
        """1, 2, ... within a key."""
        carried = self._carry(self.ends, 0, lambda a, e: a + e["n"])
        local = F.row_number().over(self.local).cast("long")
        here = self._join(carried, "__c", "long") if carried else F.lit(None).cast("long")
        self._add(name, local + F.coalesce(here, F.lit(0)))
        self.line = self.line.drop("__c")
        return name

    def total(self, name: str = "total") -> str:
        """The rows of a key."""
        before, after = self._carry(self.ends, 0, lambda a, e: a + e["n"]), self._carry(self.ends, 0, lambda a, e: a + e["n"], back=True)
        local = F.count("*").over(W.partitionBy("part", "k"))
        a = self._join(before, "__a", "long") if before else F.lit(None).cast("long")
        b = self._join(after, "__b", "long", back=True) if after else F.lit(None).cast("long")
        self._add(name, local + F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        self.line = self.line.drop("__a", "__b")
        return name

    def running_sum(self, column: str, name: str = "running") -> str:
        """The sum of a column up to each row; whole numbers exactly."""
        kind = self.line.select(F.sum(self._column(column)).alias("s")).schema["s"].dataType
        carried = self._carry(self._edges(self._from(column), s=F.sum(self._column(column))), None, lambda a, e: e["s"] if a is None else a if e["s"] is None else a + e["s"])
        carried = {p: v for p, v in carried.items() if v is not None}
        local = F.sum(self._column(column)).over(self.local.rowsBetween(W.unboundedPreceding, 0))
        here = self._join(carried, "__c", kind) if carried else F.lit(None).cast(kind)
        self._add(name, F.when(here.isNull(), local).when(local.isNull(), here).otherwise(local + here))
        self.line = self.line.drop("__c")
        return name

    def last_value(self, column: str, name: str = "last", back: bool = False) -> str:
        """The nearest value that is not null, this row's or one before (back: after) it."""
        x = self._column(column)
        kind, pick = self._kind(column), F.min_by if back else F.max_by
        seen = pick(F.struct(x.alias("x")), F.when(x.isNotNull(), F.col("i")))
        carried = self._carry(self._edges(self._from(column), v=seen), None, lambda a, e: a if e["v"] is None or e["v"]["x"] is None else e["v"], back)
        carried = {p: (v["x"],) for p, v in carried.items() if v is not None}
        # backwards as a frame up to the row, too: one from the row to the end is aggregated anew for each row
        line = W.partitionBy("part", "k").orderBy(F.desc("i")) if back else self.local
        local = F.last(x, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0))
        here = self._join(carried, "__c", T.StructType([T.StructField("x", kind)]), back)["x"] if carried else F.lit(None).cast(kind)
        self._add(name, F.coalesce(local, here))
        self.line = self.line.drop("__c")
        return name

    def shift(self, column: str, periods: int = 1, name: str = "shifted") -> str:
        """The value so many rows before (negative: after), null where there is none."""
        back, p = periods < 0, abs(periods)
        if p == 0:
            return self._add(name, self._column(column))
        if p > CARRIED:
            return self._shift_by_number(column, periods, name)
        kind = self._kind(column)
        sizes = self.base.groupBy("part").agg(F.max("i").alias("most"))
        close = F.col("i") < p if back else F.col("most") - F.col("i") < p
        told = F.struct("i", "k", self._column(column).alias("x"))
        ends = self._from(column).join(F.broadcast(sizes), "part").filter(close).groupBy("part").agg(F.sort_array(F.collect_list(told)).alias("rows"))
        ends = {r["part"]: r["rows"] for r in ends.collect()}
        carried: dict[int, Any] = {}
        held: list = []  # rows next to the range, nearest first
        for part, first, last, _ in reversed(self.ends) if back else self.ends:
            near = [r["x"] for r in held if _same(r["k"], (last if back else first)["k"])]
            if near:
                carried[part] = near[:p]
            rows = ends[part]
            held = ((rows if back else rows[::-1]) + held)[:p]
        step = F.lead if back else F.lag
        local, n = step(self._column(column), p).over(self.local), F.row_number().over(self.local if not back else W.partitionBy("part", "k").orderBy(F.desc("i")))
        if not carried:
            return self._add(name, local)
        here = self._join(carried, "__c", T.ArrayType(kind), back)
        self._add(name, F.when(n > p, local).otherwise(F.get(here, p - n)))
        self.line = self.line.drop("__c")
        return name

    def _shift_by_number(self, column: str, periods: int, name: str) -> str:
        self.number("__n")
        line = frames.cut_lineage(self.line)
        other = line.select(F.col("k").alias("__k"), (F.col("__n") + periods).alias("__m"), self._column(column).alias(name))
        self.line = line.join(other, (F.col("k").eqNullSafe(F.col("__k"))) & (F.col("__n") == F.col("__m")), "left").drop("__n", "__k", "__m")
        self.made[name] = True
        return name

    # of those above
    def ntile(self, n: int, name: str = "ntile") -> str:
        """n buckets of each key, the first ones larger by one, as in SQL."""
        self.number("__n")
        self.total("__t")
        q, r = F.floor(F.col("__t") / n).cast("long"), F.col("__t") % n
        large = r * (q + 1)
        rest = F.col("__n") - large
        bucket = F.when(F.col("__n") <= large, F.floor((F.col("__n") - 1) / (q + 1)) + 1).otherwise(r + F.floor((rest - 1) / F.greatest(q, F.lit(1))) + 1)
        self._add(name, bucket.cast("long"))
        self.line = self.line.drop("__n", "__t")
        return name

    def rank(self, name: str = "rank", dense: bool = False) -> str:
        """Ties have the number of the first of them; dense: numbers without gaps."""
        carried, kind = self._ties()
        here = self._join(carried, "__c", kind) if carried else F.lit(None).cast(kind)
        along = W.partitionBy("part", "k").orderBy(F.col("o").desc() if self.descending else F.col("o").asc())
        local, place = F.dense_rank().over(along).cast("long"), F.rank().over(along).cast("long")
        if dense:
            self._add(name, local + F.coalesce(here["d"], F.lit(0)))
        else:
            self._add(name, F.when((local == 1) & here["first"].isNotNull(), here["first"]).otherwise(place + F.coalesce(here["n"], F.lit(0))))
        self.line = self.line.drop("__c")
        return name

    def _ties(self) -> tuple[dict[int, Any], T.StructType]:
        """Per range whose first key began before it: rows (n) and orders (d) of the key before the range, without one that
        goes on in it, of which `first` is the rank. One job over the rows that were stored; Spark compares the orders."""
        kind = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "d", "first")])
        if self.tied is None:
            ties = self.base.groupBy("part", "k", "o").agg(F.count("*").alias("t"), F.min("i").alias("a"))
            each = ties.groupBy("part", "k").agg(F.min("a").alias("a"), F.sum("t").alias("n"), F.count("*").alias("d"), F.min_by("o", "a").alias("lo"), F.max_by("o", "a").alias("hi"), F.max_by("t", "a").alias("t"))
            told = F.struct("k", "n", "d", "lo", "hi", "t")
            ends = each.groupBy("part").agg(F.min_by(told, "a").alias("first"), F.max_by(told, "a").alias("last"), F.count("*").alias("keys"))
            on = F.coalesce(F.col("first.lo").eqNullSafe(F.lag("last.hi").over(W.orderBy("part"))), F.lit(False))  # a row per range
            key, n, d, t, self.tied = None, 0, 0, 0, {}
            for r in ends.withColumn("on", on).orderBy("part").collect():
                near, far, goes_on = r["first"], r["last"], False
                if key is not None and _same(near["k"], key):
                    goes_on = r["on"]
                    self.tied[r["part"]] = (n, d - goes_on, n - t + 1 if goes_on else None)
                else:
                    n = d = t = 0
                if r["keys"] == 1:
                    n, d, t = n + near["n"], d + near["d"] - goes_on, near["t"] + (t if goes_on and near["d"] == 1 else 0)
                else:
                    n, d, t = far["n"], far["d"], far["t"]
                key = far["k"]
        return self.tied, kind

    def interpolate(self, column: str, name: str = "line") -> str:
        """Nulls on the line between the values before and after, by position; after the last value it stays."""
        self.number("__n")
        x = self._column(column).cast("double")
        self._add("__at", F.when(x.isNotNull(), F.struct(F.col("__n").alias("n"), x.alias("x"))))
        self.last_value("__at", "__lo")
        self.last_value("__at", "__hi", back=True)
        lo, hi = F.col("__lo"), F.col("__hi")
        on = lo["x"] + (hi["x"] - lo["x"]) * (F.col("__n") - lo["n"]) / (hi["n"] - lo["n"])
        self._add(name, F.when(x.isNotNull(), x).when(lo.isNotNull() & hi.isNotNull(), on).otherwise(lo["x"]))
        self.line = self.line.drop("__n", "__at", "__lo", "__hi")
        return name

    def frame(self, *names: str, replace: dict[str, str] | None = None) -> DataFrame:
        """The rows as they came, with the columns made under `names`; replace: columns to take from ones made."""
        own = [(F.col((replace or {})[c]) if c in (replace or {}) else F.col(self.place[c])).alias(c) for c in self.columns]
        return self.line.select(*own, *(F.col(n) for n in names))


def _same(a: Any, b: Any) -> bool:
    """Whether two keys are one, NaN being equal to itself."""
    return len(a) == len(b) and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[tuple[str, str]] | None = None, columns: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Every row of left with the columns of the last row of right at or before its time, within equal keys `by`; nulls
    where there is none. Of rows of right at one time the last by `ties` is taken. Null times of left match nothing, null
    keys match nothing; rows of right without a time are left out.

    Both sides are put in one order, and the last row of right is carried along and across ranges: no key is gathered in a
    task, and nothing is sent to all executors."""
    by, columns, ties = by or [], columns if columns is not None else right.columns, ties or []
    kind = T.StructType([T.StructField(f"r{i}", right.schema[c].dataType) for i, c in enumerate(columns)])
    l_ = F.struct(*(quoted(c).alias(f"l{i}") for i, c in enumerate(left.columns)))
    r_ = F.struct(*(quoted(c).alias(f"r{i}") for i, c in enumerate(columns)))
    keyed = lambda df, side, at: [quoted(p[side]).alias(f"k{i}") for i, p in enumerate(by)] + [quoted(at).alias("t")]
    tie = lambda df: [quoted(c).alias(f"x{i}") for i, c in enumerate(ties)]
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(f"x{i}") for i, c in enumerate(ties)]
    known = [quoted(right_on).isNotNull(), *(quoted(q).isNotNull() for _, q in by)]
    keep = known[0]
    for k in known[1:]:
        keep &= k
    a = left.select(*keyed(left, 0, left_on), F.lit(1).alias("side"), *nothing, l_.alias("l"), F.lit(None).cast(kind).alias("r"))
    b = right.filter(keep).select(*keyed(right, 1, right_on), F.lit(0).alias("side"), *tie(right), F.lit(None).cast(a.schema["l"].dataType).alias("l"), r_.alias("r"))
    both = Segments(a.unionByName(b), [f"k{i}" for i in range(len(by))], ["t", "side", *(f"x{i}" for i in range(len(ties)))])
    both.last_value("r", "found")
    out = both.frame("found").filter("side = 1")
    names = [c if c not in left.columns else f"{c}_right" for c in columns]
    return out.select(*(F.col(f"l.l{i}").alias(c) for i, c in enumerate(left.columns)), *(F.col(f"found.r{i}").alias(c) for i, c in enumerate(names)))
