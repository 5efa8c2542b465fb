"""Approximate nearest neighbours by several Hilbert orderings of projected vectors.

Every vector is projected to a few dimensions, once per curve with another rotation and shift, and gets its place on a
Hilbert curve there. Spark sorts each curve by ranges; a query is compared with the vectors whose rank on a curve is
within a window of its own, by exact cosine in double precision, and the windows of all curves merge. Curves are cut in
blocks of fixed size; queries are copied to the blocks that their windows touch, so that a task holds one block.

Windows are fitted on samples: `FIT_ROWS` vectors, chosen by a hash, give the spread of the projections, and for `SAMPLE`
others the true neighbours are found by brute force. Of two curves to `CURVES`, each number needs a smallest window that
would have found `target` of them; the number that compares the fewest pairs is taken. Every vector is indexed. Vectors
without structure need wide windows, clustered ones narrow ones.

Equal vectors are indexed once, as a class that knows its smallest ids, so that a very common vector costs nothing.
Vectors of different lengths have no cosine; each length is searched on its own.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; all
finite vectors do, however large or small their components; rows that repeat an id and vector count once; equal cosines
go by id; with fewer candidates of its length than asked for, a query gets them all; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

CURVES = 8
DIMS = 6
BITS = 9
BLOCK = 4096
#: Queries that are compared with a block at a time, about.
ASKED = 4096
SAMPLE = 200
TARGET = 0.97
FIT_ROWS = 10_000
SALTS = 32


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates (rows) below 2 ** bits.

    The coordinates are first undone from the curve's reflections and exchanges, from the highest bit down, then Gray
    coded, and their bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            flip = (x[i] >> b & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def classes(vectors: DataFrame, vec_id: str, embedding: str, is_query: Column, most: int) -> DataFrame:
    """Distinct vectors: h (two hashes), id (smallest), members (at most `most` smallest ids), asked, v."""
    v = F.col(embedding)
    ok = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(ok).select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("asked"))
    rows = rows.withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    asked = rows.groupBy("h").agg(F.max("asked").alias("asked"))
    first = rows.select("h", "id", "v").withColumn("salt", F.pmod("id", F.lit(SALTS)))
    for keys in (["h", "salt"], ["h"]):
        w = W.partitionBy(*keys).orderBy("id")
        first = first.withColumn("dup", F.lag("id").over(w).eqNullSafe(F.col("id"))).filter(~F.col("dup")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    one = first.groupBy("h").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("members"), F.min_by("v", "id").alias("v"))
    return stored(one.join(asked, "h"), "ann-classes")


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix and their norms. Vectors are scaled by powers of two, which changes no cosine, so that no square
    is too large or too small for a double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x, np.sqrt((x * x).sum(1))


def _best(q: tuple, x: tuple, ids: np.ndarray, k: int, may=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query (row, place of its k nearest, cosine); equal cosines in the order of ids. may(a, b): allowed pairs of
    queries a:b."""
    rows, cols, scores = [], [], []
    (qv, qn), (xv, xn) = q, x
    for a in range(0, len(qv), 256):
        s = (qv[a : a + 256] / qn[a : a + 256, None]) @ (xv / xn[:, None]).T
        if may is not None:
            s[~may(a, a + 256)] = -2
        kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        r, c = np.nonzero((s >= kth[:, None] - 1e-12) & (s > -1.5))
        exact = (qv[a + r] * xv[c]).sum(1) / (qn[a + r] * xn[c])  # the same number in whatever block a pair meets
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(a + r[place < k])
        cols.append(c[place < k])
        scores.append(exact[place < k])
    return (np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _ranks(cls: DataFrame, dims: int, seed: int, curves: int, fit: np.ndarray) -> DataFrame:
    """curve, id, rank: places of all classes on every curve."""
    width = fit.shape[1]
    rng = np.random.Generator(np.random.PCG64(seed))
    maps = []
    for _ in range(curves):
        basis = np.linalg.qr(rng.normal(size=(width, width)))[0][:, : min(dims, width)]
        on = (fit / np.sqrt((fit * fit).sum(1))[:, None]) @ basis
        maps.append((basis, on.mean(0), on.std(0) + 1e-9, rng.uniform(-0.08, 0.08, basis.shape[1])))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _unit(batch.column("v"))
            ids = batch.column("id")
            for c, (basis, mean, sd, shift) in enumerate(maps):
                place = np.clip(((x / n[:, None]) @ basis - mean) / sd / 7 + 0.5 + shift, 0, 1 - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert((place * (1 << BITS)).astype(np.int64), BITS)), ids], ["curve", "key", "id"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(i, i + len(batch))), batch.column("curve"), batch.column("id")], ["part", "i", "curve", "id"])
            i += len(batch)

    spark = cls.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cls.select("id", "v").mapInArrow(keys, "curve int, key long, id long")
    line = placed.repartitionByRange(n, "curve", "key", "id").sortWithinPartitions("curve", "key", "id").mapInArrow(number, "part int, i long, curve int, id long")
    line = stored(line, "ann-line")
    sizes = sorted((r["part"], r["n"]) for r in line.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, size in sizes:
        starts.append((part, at))
        at += size
    offset = spark.createDataFrame(starts, "part int, offset long")
    total = at // curves
    return line.join(F.broadcast(offset), "part").select("curve", "id", (F.col("offset") + F.col("i") - F.col("curve") * F.lit(total)).alias("rank"))


def window(cls: DataFrame, ranks: DataFrame, k: int, sample: int, target: float) -> tuple[int, int]:
    """How many curves, and the smallest window in which `target` of the true k nearest of `sample` vectors lie on one of
    them, such that the fewest pairs are compared."""
    some = cls.select("id", "v").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).toArrow()
    qid, q = some.column("id").to_numpy(), _unit(some.column("v"))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            r, c, s = _best(q, _unit(batch.column("v")), ids, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[c]), pa.array(s)], ["q", "id", "s"])

    order = W.partitionBy("q").orderBy(F.desc("s"), "id")
    near = cls.select("id", "v").mapInArrow(brute, "q long, id long, s double").filter("q <> id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    near = stored(near.select("q", "id"), "ann-truth")
    there = ranks.join(F.broadcast(near), "id").select("q", "id", "curve", "rank")
    mine = ranks.join(F.broadcast(near.select("q").distinct().withColumnRenamed("q", "id")), "id").select(F.col("id").alias("q"), "curve", F.col("rank").alias("own"))
    gap = there.join(F.broadcast(mine), ["q", "curve"]).select("q", "id", "curve", F.abs(F.col("rank") - F.col("own")).alias("gap")).toPandas()
    if not len(gap):
        return 2, 0
    best = np.minimum.accumulate(gap.pivot(index=["q", "id"], columns="curve", values="gap").to_numpy(), axis=1)
    n, at = cls.count(), min(len(best) - 1, int(np.ceil(target * len(best))))
    wide = np.sort(best, axis=0)[at].astype(np.int64)
    curves = np.arange(1, best.shape[1] + 1)
    cost = curves * np.minimum(n, 2 * wide + 1)
    chosen = 1 + int(np.argmin(cost[1:])) if len(cost) > 1 else 0
    return int(curves[chosen]), int(wide[chosen])


def _in_block(wide: int, k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, rank = rows.column("id").to_numpy(), rows.column("rank").to_numpy()
        qid, own = asked.column("id").to_numpy(), asked.column("rank").to_numpy()
        if not len(ids) or not len(qid):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        r, c, s = _best(_unit(asked.column("v")), _unit(rows.column("v")), ids, k, lambda a, b: np.abs(own[a:b, None] - rank[None, :]) <= wide)
        return pa.table({"q": pa.array(qid[r]), "id": pa.array(ids[c]), "score": pa.array(s)})

    return run


def _of_length(cls: DataFrame, k: int, curves: int, dims: int, seed: int, target: float, sample: int, wide: int | None) -> DataFrame:
    """q, id, score: nearest classes of one length."""
    fit = _unit(cls.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(FIT_ROWS).select("v").toArrow().column("v"))[0]
    ranks = stored(_ranks(cls, dims, seed, curves, fit), "ann-ranks")
    if wide is None:
        curves, wide = window(cls, ranks, k, sample, target)
    n, asked = cls.agg(F.count("*"), F.count_if("asked")).first()
    wide = min(wide, n)
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    placed = ranks.filter(F.col("curve") < curves).join(cls.select("id", "v", "asked"), "id")
    # the queries that meet a block are dealt to parts, with a copy of the block in each
    parts = -(-min(asked, BLOCK + 2 * wide) // ASKED)
    rows = placed.select("curve", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(max(1, parts) - 1))).alias("part"), "rank", "id", "v")
    last = F.floor(F.lit(max(0, n - 1)) / BLOCK).cast("long")
    touched = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("rank") - wide) / BLOCK).cast("long")), F.least(last, F.floor((F.col("rank") + wide) / BLOCK).cast("long")))
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, parts))).cast("int")
    want = placed.filter("asked").select("curve", F.explode(touched).alias("block"), part.alias("part"), "rank", "id", "v").toDF("curve_", "block_", "part_", "rank", "id", "v")
    return rows.groupBy("curve", "block", "part").cogroup(want.groupBy("curve_", "block_", "part_")).applyInArrow(_in_block(wide, k + 1), "q long, id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", curves: int = CURVES, dims: int = DIMS, seed: int = 17, target: float = TARGET, sample: int = SAMPLE, wide: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row for which is_query holds, its k nearest found among the other
    rows, by cosine, equal ones by id."""
    cls = classes(vectors, vec_id, embedding, is_query, k + 1)
    found = vectors.sparkSession.createDataFrame([], "q long, id long, score double")
    for r in cls.groupBy(F.size("v").alias("n")).agg(F.max("asked").alias("asked")).orderBy("n").collect():
        if r["asked"]:
            found = found.unionByName(_of_length(cls.filter(F.size("v") == r["n"]), k, curves, dims, seed, target, sample, wide))
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1).drop("rn")
    members = cls.select("id", F.explode("members").alias("vec_id"))
    near = found.join(members, "id").select("q", "vec_id", "score")
    queries = vectors.filter(is_query).select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("v")).distinct()
    queries = queries.select("query_id", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")).alias("h")).join(cls.select("h", F.col("id").alias("q")), "h")
    pairs = queries.join(near, "q").filter("query_id <> vec_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
