"""Mixing sources to target weights by pivotal dependent rounding.

A source's target share of words gives each of its documents an expected number of copies, target / source size. Its
whole part is certain; the fractions are rounded by pairing: of two documents of a source, one gains and the other loses
copy probability such that the words expected of both stay the same and the chances of each stay right, until one of the
two is integral. Sums of words are thereby kept exactly while a pair is left. Blocks of documents are rounded on their
own and leave one fractional document each at most; these residuals meet in blocks on the next level, and so on, until
each source has one. Without a partner, it is rounded to the nearer number; a source's taken words miss the target by
at most half the size of that document. Large documents come first, so that small ones can absorb their fractions.

Randomness is a hash of seed, level and document, and blocks are ordered by key, so that reruns agree.

Sources are a table too, of any size: their order, their targets and their blocks are computed in Spark.

Defined cases: a null text counts 0 words; the null source is a source of its own, last in the order; rows that repeat a
document (same doc_id, source and text) share one decision; documents of equal size go by a hash of their row; a very
long text counts as its words and is rounded like others; sources without words take nothing; an empty table gives an
empty result; other columns are kept by `mix` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frames import ranked

from .common import n_words, own_names, small, stored

BLOCK = 4096
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds `s`, a number for each source, and `target`, its words, to rows (source, source_size). Weights repeat over the
    sources in code point order, null last. A source's target stops at cap times its size; the excess is shared again by
    weight among the others until none is above: each round is two sums over the sources, and closes one at least."""
    order = (F.col("source").isNull(), F.col("source"))  # strings are ordered by their bytes in UTF-8, that is by code point
    line = stored(ranked(sources, *order, name="s", start=0), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("s"), F.lit(len(weights))) + 1).cast("int"))
    line = line.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    size, total = line.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, closed = share * size, 0
    while True:
        own = F.lit(float(left)) * F.col("weight") / F.lit(total or 1.0)
        above = own > F.col("most")
        n, most, open_ = line.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == closed or not open_:
            return line.withColumn("target", F.when(above, F.col("most")).otherwise(own)).drop("weight", "most")
        left, total, closed = share * size - most, open_, n


def _unit(key: np.ndarray, level: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from keys."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64((seed * 1000 + level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(size: np.ndarray, p: np.ndarray, chance: np.ndarray, last: bool) -> np.ndarray:
    """Rounds probabilities p one pair at a time, keeping sum(size * p); at most one stays fractional unless `last`."""
    p, held = p.copy(), -1
    for j in range(len(p)):
        if size[j] == 0:  # takes no words either way
            p[j] = float(chance[j] < p[j])
            continue
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, size[held], size[j]
        up = min((1 - p[i]) * a, p[j] * b)  # words that can move from j to i
        down = min(p[i] * a, (1 - p[j]) * b)  # and from i to j
        if chance[j] < down / (up + down):
            full = (1 - p[i]) * a <= p[j] * b
            p[i], p[j] = (1.0, p[j] - up / b) if full else (p[i] + up / a, 0.0)
        else:
            full = p[i] * a <= (1 - p[j]) * b
            p[i], p[j] = (0.0, p[j] + down / b) if full else (p[i] - down / a, 1.0)
        for k in (i, j):
            p[k] = 0.0 if p[k] < 1e-12 else 1.0 if p[k] > 1 - 1e-12 else p[k]
        held = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    if last and held >= 0:
        p[held] = np.round(p[held])
    return p


def _round(level: int, seed: int):
    """Rows (key, s, n, weight, p, b, last), those of a block together and its largest documents first, rounded."""

    def rounded(rows: pa.Table) -> pa.RecordBatch:
        s, b, key, weight, p, last = (rows.column(c).to_numpy() for c in ("s", "b", "key", "weight", "p", "last"))
        chance, got = _unit(key, level, seed), p.copy()
        start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (b[1:] != b[:-1])]))
        for i, j in zip(start, [*start[1:], len(s)], strict=True):
            got[i:j] = pivot(weight[i:j], p[i:j], chance[i:j], bool(last[i]))
        columns = [*(rows.column(c).combine_chunks() for c in ("key", "s", "n", "weight")), pa.array(got)]
        return pa.RecordBatch.from_arrays(columns, ["key", "s", "n", "weight", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a block that may go on
        for batch in batches:
            if not len(batch):
                continue
            s, b = batch.column("s").to_numpy(), batch.column("b").to_numpy()
            before = np.flatnonzero((s != s[-1]) | (b != b[-1]))
            cut = int(before[-1]) + 1 if len(before) else 0
            if held and (held[0].column("s")[0].as_py(), held[0].column("b")[0].as_py()) != (s[0], b[0]):
                yield rounded(pa.Table.from_batches(held))
                held = []
            if cut:
                yield rounded(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield rounded(pa.Table.from_batches(held))

    return run


def plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """A row per distinct document (doc_id, source, text): doc_id, source, key (its hash), rows (how many it stands
    for), size (words of one row), source_size, target, copies (of each row)."""
    spark = docs.sparkSession
    units = docs.groupBy("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), n_words(F.col("text")).alias("size")).agg(F.count("*").alias("rows"))
    units = stored(units.withColumn("key", F.xxhash64("doc_id", "source", "text_hash")), "mix-units")
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    aim = stored(targets(per, share, cap, weights), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = small(aim.select(F.col("source").alias("src"), "s", "source_size", "target", rate.alias("rate"), "n"))
    known = units.join(sources, units["source"].eqNullSafe(F.col("src"))).drop("src")
    certain = F.floor("rate")

    def dealt(rows: DataFrame, level: int, *more) -> DataFrame:
        """Blocks of a level: as many as documents may be left, in each of which at most one was."""
        many = F.col("n")
        for _ in range(level + 1):
            many = F.greatest(F.lit(1), F.ceil(many / block))
        return rows.select("key", "s", "n", *more, F.pmod(F.xxhash64("key", F.lit(seed + level)), many).alias("b"), (many == 1).alias("last"))

    most = aim.agg(F.max("n")).first()[0] or 0
    todo = dealt(known, 0, (F.col("size") * F.col("rows")).cast("double").alias("weight"), (F.col("rate") - certain).alias("p"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done, level = [], 0
    while True:
        ordered = todo.repartition(parts, "s", "b").sortWithinPartitions("s", "b", F.desc("weight"), F.desc("key"))
        out = stored(ordered.mapInArrow(_round(level, seed), "key long, s long, n long, weight double, p double"), f"mix-level{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.filter(~open_).select("key", "p"))
        if most <= block ** (level + 1):
            break
        level += 1
        todo = dealt(out.filter(open_), level, "weight", "p")
    taken = done[0]
    for x in done[1:]:
        taken = taken.unionByName(x)
    taken = taken.groupBy("key").agg(F.max("p").alias("p"))
    return known.join(taken, "key").select("doc_id", "source", "key", "rows", "size", "source_size", "target", (certain + F.col("p")).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, all columns as they are, each row as often as its copies say."""
    name = own_names(docs, "key", "copies", "i")
    decided = plan(docs, **options).filter("copies > 0").select(F.col("key").alias(name["key"]), F.col("copies").alias(name["copies"]))
    key = F.xxhash64("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = docs.withColumn(name["key"], key).join(decided, name["key"])
    each = keyed.withColumn(name["i"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(name["copies"]))))
    return each.select(*(F.col(f"`{c}`") for c in docs.columns))
