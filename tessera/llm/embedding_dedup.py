"""Near duplicates among vectors by spherical-cap filters.

Filters are directions of a random product code: a rotated vector is cut in blocks, every block has a codebook of random unit
vectors, and a filter is one word of each. A vector's list are the filters whose caps it exceeds, the cap of each vector
being as wide as holds `t` of them; they are decoded from the sorted scores of the blocks, without looking at all filters.
Two vectors that share a filter are candidates. Filters are as many as all entries of lists, so a filter has one vector of
unrelated ones, about, at any size of the table; t is fitted on a sample, as the shortest list with which pairs right at the
threshold share a filter but for a share of `MISS`. There are `CODES` codes, each drawn anew, so a pair is lost only if it
shares no filter of any: `MISS` to the power of their number, right at the threshold, and far less above. An entry carries 64 signs of random projections, so that candidates are
told from strangers in the join on filters; those left are verified by cosine in double precision.

Filters with more than `HEAVY` vectors come from dense groups, whose pairs are never listed. A vector of such filters lives
in the cell of its fullest one, cells are cut in tiles of about `TILE` vectors by their angle to the cell's centre, and
cells that share a filter meet tile by tile: where the triangle inequality says that all pairs link or none does, counts
of the tiles are all that is needed; other tiles are compared by one product of matrices, which gives a count per vector
and a tree over those that link. A pair of vectors is judged in one place only, by cells or by light filters.

Equal vectors are one class with a count, so copies cost nothing. Vectors of different lengths have no cosine; each length
is joined on its own.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing and keep their row, as do
all of a null id, whose component is null; every row is a vector, also where ids repeat: a component is named by its smallest
id; an empty table gives no rows; other columns do not matter."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ann import _unit
from .common import discard, small, stored
from .components import components

THRESHOLD = 0.95
LISTS = (16, 24, 32, 48, 64, 96, 128)
MISS = 0.003
CODES = 2
FIT_ROWS = 2000
#: Words in a codebook at most; more filters take more blocks.
WORDS = 8192
HEAVY = 48
TILE = 512
#: Degrees of angle to the centre that tiles of a cell are told by.
BAND = 1.0
SIGNS = 64
#: Vectors sent to all executors at most.
SENT = 20_000
_SURE = 1e-7


class Code(NamedTuple):
    """A random product code of filters, and the directions of the signs."""

    turn: np.ndarray
    books: list[np.ndarray]
    signs: np.ndarray
    t: int

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        y, at, out = x @ self.turn, 0, []
        for b in self.books:
            out.append(y[:, at : at + b.shape[1]] @ b.T)
            at += b.shape[1]
        return out

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The numbers of the t best filters of every row of unit vectors (all, if fewer)."""
        value, key = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for s in self.scores(x):
            n = s.shape[1]
            best = np.argpartition(-s, min(self.t, n) - 1, axis=1)[:, : self.t]
            v = np.take_along_axis(s, best, 1)
            order = np.argsort(-v, axis=1, kind="stable")
            best, v = np.take_along_axis(best, order, 1), np.take_along_axis(v, order, 1)
            # of two sorted lists, the sum of the ith and the jth has i * j sums that are as large
            i, j = np.nonzero(np.arange(1, value.shape[1] + 1)[:, None] * np.arange(1, v.shape[1] + 1)[None, :] <= self.t)
            value, key = value[:, i] + v[:, j], key[:, i] * n + best[:, j]
            order = np.argsort(-value, axis=1, kind="stable")[:, : self.t]
            value, key = np.take_along_axis(value, order, 1), np.take_along_axis(key, order, 1)
        return key

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.signs > 0, axis=1, bitorder="little").view(np.int64)[:, 0]


def product_code(width: int, rows: int, t: int, seed: int) -> Code:
    """A code of about rows * t filters."""
    rng = np.random.Generator(np.random.PCG64(seed))
    blocks = 2
    while (rows * t) ** (1 / blocks) > WORDS:
        blocks += 1
    blocks = min(blocks, width)
    words = max(2, int(np.ceil((rows * t) ** (1 / blocks)))) if blocks > 1 else 2
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    books = []
    for cut in np.array_split(np.arange(width), blocks):
        c = rng.normal(size=(words, len(cut)))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return Code(turn, books, rng.normal(size=(width, SIGNS)), t)


def missed(code: Code, x: np.ndarray, cosine: float, seed: int) -> float:
    """The share of pairs right at the cosine, of given unit vectors and drawn partners, that share no filter."""
    z = np.random.Generator(np.random.PCG64(seed)).normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    a, b = code.lists(x), code.lists(y)
    return float(np.mean([not np.intersect1d(p, q).size for p, q in zip(a, b, strict=True)])) if len(x) else 0.0


def fit(x: np.ndarray, rows: int, cosine: float, seed: int) -> Code:
    """The code with the shortest lists that do; x: a sample of unit vectors."""
    for t in LISTS:
        code = product_code(x.shape[1], rows, t, seed)
        if x.shape[1] < 2 or missed(code, x, cosine, seed) <= MISS:
            break
    return code


def _far(cosine: float) -> int:
    """Signs in which two vectors may differ that are at the cosine, with six standard deviations."""
    p = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    return min(SIGNS, int(np.ceil(SIGNS * p + 6 * np.sqrt(SIGNS * p * (1 - p)))))


def valid(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def _named(v: Column) -> Column:
    return F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b"))


def _entries(codes: list[Code]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                x, n = _unit(part.column("v"))
                x = x / n[:, None]
                found = np.hstack([code.lists(x) * len(codes) + c for c, code in enumerate(codes)])
                many = found.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(part.column("k").to_numpy(), many)), pa.array(np.repeat(codes[0].sketch(x), many))], ["f", "k", "s"])

    return run


def _cosine(a: str, b: str, keep: list[str]):
    """Adds the cosine of two columns of vectors to the columns named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, nx), (y, ny) = _unit(batch.column(a)), _unit(batch.column(b))
            c = (x * y).sum(1) / (nx * ny) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(c)], [*keep, "cosine"])

    return run


def _angles(df: DataFrame, a: str, b: str) -> DataFrame:
    """The other columns, and the angle of two vectors in degrees."""
    keep = [f for f in df.schema.fields if f.name not in (a, b)]
    out = df.mapInArrow(_cosine(a, b, [f.name for f in keep]), T.StructType([*keep, T.StructField("cosine", T.DoubleType())]))
    return out.withColumn("angle", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine")))))).drop("cosine")


def _tile(threshold: float):
    """Vectors of two tiles, or of one: per vector how many it links with, and an edge to a tree over each set that links."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        one = not len(right)
        right = left if one else right
        k, l = left.column("k").to_numpy(), right.column("k").to_numpy()
        (x, nx), (y, ny) = _unit(left.column("v")), _unit(right.column("v"))
        link = (x / nx[:, None]) @ (y / ny[:, None]).T
        near = np.abs(link - threshold) < 1e-9
        link = link >= threshold
        r, c = np.nonzero(near)
        link[r, c] = (x[r] * y[c]).sum(1) / (nx[r] * ny[c]) >= threshold
        if one:
            np.fill_diagonal(link, False)
        m, n = left.column("m").to_numpy(), right.column("m").to_numpy()
        root_l = k.copy()  # of the smallest number that is reached
        while True:
            by_right = np.minimum(np.where(link, root_l[:, None], np.iinfo(np.int64).max).min(0), l)
            new = np.minimum(np.where(link, by_right[None, :], np.iinfo(np.int64).max).min(1), root_l)
            if (new == root_l).all():
                break
            root_l = new
        node, count, to = [k], [link @ n], [root_l]
        if not one:
            node, count, to = [*node, l], [*count, m @ link], [*to, by_right]
        return pa.table({"k": np.concatenate(node), "n": np.concatenate(count).astype(np.int64), "to": np.concatenate(to)})

    return run


def _dense(heavy: DataFrame, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of vectors in heavy filters (f, k, size): (k, home), the pairs of cells judged here (h1 <= h2), (k, n) counts of
    links, (a, b) edges that connect what links."""
    wide = float(np.degrees(np.arccos(np.clip(threshold, -1, 1))))
    home = stored(heavy.groupBy("k").agg(F.max_by("f", F.struct(F.col("size"), -F.col("f"))).alias("home")), "near-home")
    cell = home.groupBy("home").agg(F.min("k").alias("k")).join(classes.select("k", F.col("v").alias("centre")), "k").select("home", "centre")
    cell = stored(cell, "near-cells")
    many = cell.count()
    at = home.join(classes.select("k", "v", "m"), "k").join(small(cell, many, SENT), "home")
    at = _angles(at.withColumn("w", F.col("v")), "w", "centre").withColumn("band", F.floor(F.col("angle") / BAND).cast("int"))
    at = stored(at, "near-dense")
    sizes = at.groupBy("home", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    tile = F.struct("home", "band", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"))
    placed = stored(at.join(small(stored(sizes, "near-bands")), ["home", "band"]).select(tile.alias("tile"), "k", "v", "m", "angle"), "near-placed")
    tiles = placed.groupBy("tile").agg(F.sum("m").alias("n"), F.min("k").alias("first"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    tiles = stored(tiles, "near-tiles")

    there = heavy.join(small(home), "k").select("f", "home").distinct()
    pairs = there.toDF("f", "h1").join(there.toDF("f", "h2"), "f").filter("h1 <= h2").select("h1", "h2").distinct()
    pairs = pairs.join(small(cell.toDF("h1", "c1"), many, SENT), "h1").join(small(cell.toDF("h2", "c2"), many, SENT), "h2")
    pairs = stored(_angles(pairs, "c1", "c2"), "near-cell-pairs").withColumn("angle", F.when(F.col("h1") == F.col("h2"), 0.0).otherwise(F.col("angle")))
    side = lambda i: small(tiles.select(F.col("tile.home").alias(f"h{i}"), *(F.col(c).alias(f"{c}{i}") for c in tiles.columns)))
    meet = pairs.join(side(1), "h1").join(side(2), "h2").filter("h1 < h2 OR tile1 <= tile2")
    least = F.greatest(F.col("angle") - F.col("hi1") - F.col("hi2"), F.col("lo1") - F.col("angle") - F.col("hi2"), F.col("lo2") - F.col("angle") - F.col("hi1"))
    same = F.col("tile1") == F.col("tile2")
    sure = F.col("angle") + F.col("hi1") + F.col("hi2") <= wide - _SURE
    meet = stored(meet.filter(least <= wide + _SURE).select("tile1", "tile2", "n1", "n2", "first1", "first2", same.alias("same"), sure.alias("sure")), "near-meet")

    # tiles of which all pairs link: counts, and an edge per vector
    certain = meet.filter("sure")
    other = lambda i, j: F.struct(F.col(f"tile{i}").alias("tile"), F.col(f"n{j}").alias("n"), F.col(f"first{j}").alias("first"), F.when(F.col("same"), 1).otherwise(0).alias("own"))
    both = certain.select(F.explode(F.when(F.col("same"), F.array(other(1, 2))).otherwise(F.array(other(1, 2), other(2, 1)))).alias("x")).select("x.*")
    add = stored(both.groupBy("tile").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("own").alias("own")), "near-certain")
    known = placed.select("tile", "k", "m").join(small(add), "tile")
    counts = known.select("k", (F.col("n") - F.col("own") * F.col("m")).alias("n"))
    edges = known.select(F.col("k").alias("a"), F.col("first").alias("b")).unionByName(certain.select(F.col("first1").alias("a"), F.col("first2").alias("b")))

    # the others are compared
    open_ = meet.filter("NOT sure").select("tile1", "tile2", "same")
    left = placed.withColumnRenamed("tile", "tile1").join(small(open_), "tile1").select("tile1", "tile2", "k", "v", "m")
    right = placed.withColumnRenamed("tile", "tile2").join(small(open_.filter("NOT same")), "tile2").select("tile1", "tile2", "k", "v", "m").toDF("u1", "u2", "k", "v", "m")
    told = left.groupBy("tile1", "tile2").cogroup(right.groupBy("u1", "u2")).applyInArrow(_tile(threshold), "k long, n long, to long")
    told = stored(told, "near-told")
    counts = counts.unionByName(told.filter("n > 0").select("k", "n"))
    edges = edges.unionByName(told.filter("k <> to").select(F.col("k").alias("a"), F.col("to").alias("b")))
    return home, pairs.select("h1", "h2"), counts, edges


def _of_length(classes: DataFrame, threshold: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(k, n): counts of links with other classes, and (a, b) edges; classes: k, v, m, all of one length."""
    x, n = _unit(classes.orderBy(F.xxhash64("k", F.lit(5)), "k").limit(FIT_ROWS).select("v").toArrow().column("v"))
    many = classes.count()
    codes = [fit(x / n[:, None], many, threshold, seed + c) for c in range(CODES)]
    entries = stored(classes.select("k", "v").mapInArrow(_entries(codes), "f long, k long, s long"), "near-entries")
    heavy = stored(entries.groupBy("f").agg(F.count("*").alias("size")).filter(F.col("size") > HEAVY), "near-heavy")
    many = heavy.count()
    light, dense = entries, None
    if many:
        light = entries.join(small(heavy.select("f"), many), "f", "left_anti")
        dense = _dense(entries.join(small(heavy, many), "f").select("f", "k", "size"), classes, threshold)
    near = F.bit_count(F.col("s").bitwiseXOR(F.col("s2"))) <= _far(threshold)
    pairs = light.toDF("f", "a", "s").join(light.toDF("f", "b", "s2"), "f").filter(F.col("a") < F.col("b")).filter(near).select("a", "b").distinct()
    if dense:
        home, cells, _, _ = dense
        there = small(home)
        pairs = pairs.join(there.toDF("a", "ha"), "a", "left").join(there.toDF("b", "hb"), "b", "left")
        pairs = pairs.select("a", "b", F.least("ha", "hb").alias("h1"), F.greatest("ha", "hb").alias("h2"), F.expr("ha IS NULL OR hb IS NULL").alias("free"))
        judged = pairs.filter("NOT free").join(small(cells), ["h1", "h2"], "left_anti")
        pairs = pairs.filter("free").unionByName(judged).select("a", "b")
    pairs = stored(pairs, "near-pairs")
    side = lambda x, y: classes.select(F.col("k").alias(x), F.col("v").alias(f"v{y}"), F.col("m").alias(f"m{y}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    kinds = "a long, b long, m1 long, m2 long, cosine double"
    links = both.mapInArrow(_cosine("v1", "v2", ["a", "b", "m1", "m2"]), kinds).filter(F.col("cosine") >= threshold)
    links = stored(links, "near-links")
    ends = F.array(F.struct(F.col("a").alias("k"), F.col("m2").alias("n")), F.struct(F.col("b").alias("k"), F.col("m1").alias("n")))
    counts, edges = links.select(F.explode(ends).alias("x")).select("x.*"), links.select("a", "b")
    if dense:
        counts, edges = counts.unionByName(dense[2]), edges.unionByName(dense[3])
    discard(entries, pairs)
    return counts, edges


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 23) -> DataFrame:
    """vec_id, n_links (other rows whose cosine with this one is the threshold or more), component_id (smallest id that
    is reached by links), kept (the row's id is its component's), for every row."""
    spark = vectors.sparkSession
    v, id_ = vectors[f"`{embedding}`"], vectors[f"`{vec_id}`"].cast("long")
    exact = isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    v = v if exact else v.cast("array<double>")
    rows = vectors.select(id_.alias("vec_id"), F.when(valid(v) & id_.isNotNull(), v).alias("v"))
    named = rows.filter("v IS NOT NULL").groupBy(_named(F.col("v")).alias("h")).agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = stored(named.withColumn("k", F.monotonically_increasing_id()), "near-classes")
    counts = spark.createDataFrame([], "k long, n long")
    edges = spark.createDataFrame([], "a long, b long")
    for r in classes.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():
        if r["count"] > 1:
            more, further = _of_length(classes.filter(F.size("v") == r["n"]), threshold, seed)
            counts, edges = counts.unionByName(more), edges.unionByName(further)
    root = components(edges)
    found = classes.select("h", "id", "m", "k").join(small(root), F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k")).drop("node")
    label = found.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = counts.groupBy("k").agg(F.sum("n").alias("n"))
    each = stored(found.join(label, "root").join(linked, "k", "left").select("h", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")), "near-each")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), _named(F.col("v"))).alias("h")).join(small(each), "h", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
