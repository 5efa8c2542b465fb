"""Phrases of two or three words that stand together more often than their parts let expect, by language.

Texts of a language are gathered in shards. A shard has a bitmap of positions for every word, compressed to its non-empty
64-bit blocks; between two pieces (and two texts) a position stays free, so that no phrase crosses it. A phrase is extended
depth-first: its bitmap is shifted by one position and ANDed with that of a further word, and the bits that stay are
counted. Shards send their counts, Spark sums them. A word is as frequent as a phrase around it at least, so only words that
are frequent in the whole corpus are extended. Those are numbered by Spark's sum over shards, so nothing is told by hashes.

A shard has about `SHARD_BYTES` of text, at any size of the corpus; what comes back to it are the numbers of its own words.
Its pairs are not looked up in the corpus before they are extended: that takes a join of all pairs of all shards, which was
measured and costs more than the triples that it saves, as frequent pairs make up most of a large corpus. The words that
may follow at a shifted bit are looked up by position, so that only pairs of bitmaps that share a block are ANDed. Scores are exact: products are decimals of 38 digits.

Defined cases: null texts have no words, a null language is `und`; A-Z are lower-cased, nothing else; a text of any length
is whole in one shard; occurrences that overlap count each; equal scores go by count, then by phrase in UTF-8 bytes; an
empty table gives no rows; repeated rows count each; other columns do not matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.frames import ranked

from . import tokens
from .blocks import shrunk, unpack
from .common import discard, small, stored
from .lean import lean, small_batches

UNKNOWN = "und"
MIN_COUNT = 10
TOP = 2000
SCALE = 1_000_000
#: A phrase goes if a longer one around it has this share of its occurrences, in hundredths.
COVERED = 50
#: Bytes of the texts in a shard, about.
SHARD_BYTES = 6_000_000
#: Blocks of bitmaps that are extended at a time.
ENTRIES = 300_000
SALTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True

_SHARD = "shard long, lang string, idx int, word string, n long, blob binary"


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _bits(block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, position) of every bit, in order."""
    e, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return e, (block[e] << 6) + bit


def positions(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, lower-cased, and their positions."""
    buf, off = tokens.buffer(column)
    buf = tokens.fold(buf)
    w = tokens.split(buf, off, _GAP)
    n = len(w.start)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    seen = np.concatenate([[0], np.cumsum(_BREAK[buf], dtype=np.int32)])
    apart = np.zeros(n, bool)
    apart[1:] = seen[w.start[1:]] > seen[w.end[:-1]]
    apart[w.ptr[:-1][w.ptr[:-1] < n]] = True
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)])
    words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf[~_GAP[buf]]))])
    return words, np.arange(n) + np.cumsum(apart)


def _shard(column: pa.Array) -> tuple[pa.Array, np.ndarray, bytes] | None:
    """Distinct words, their counts, and all bitmaps (word, block, mask), sorted."""
    words, at = positions(column)
    if not len(words):
        return None
    d = words.dictionary_encode()
    code = d.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    c, p = code[order], at[order]
    block = p >> 6
    start = _runs(c, block)
    mask = np.bitwise_or.reduceat(np.uint64(1) << (p & 63).astype(np.uint64), start)
    step = np.diff(block[start], prepend=0).astype(np.int32)
    blob = shrunk(word=pa.array(c[start].astype(np.int32)), step=pa.array(step), mask=pa.array(mask))
    return d.dictionary.cast(pa.string()), np.bincount(code, minlength=len(d.dictionary)), blob


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the texts of a task, language by language: a row per word, and one for the bitmaps (idx -1)."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    base, made = TaskContext.get().partitionId() << 32, 0

    def give(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made
        column = pa.chunked_array(held.pop(lang)).combine_chunks()
        del size[lang]
        for i, j in tokens.slices(column, SHARD_BYTES):
            one = _shard(column.slice(i, j - i))
            if one is not None:
                words, n, blob = one
                k, v = base + made, len(words)
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(v + 1, k)), pa.array([lang] * (v + 1)), pa.array(np.arange(-1, v, dtype=np.int32)),
                     pa.concat_arrays([pa.nulls(1, pa.string()), words]), pa.array(np.concatenate([[0], n])), pa.array([blob] + [None] * v, pa.binary())],
                    ["shard", "lang", "idx", "word", "n", "blob"],
                )

    for batch in batches:
        lang, text = batch.column(0), batch.column(1).cast(pa.large_string())
        for one in lang.unique():
            rows = text.filter(pa.compute.equal(lang, one))
            name = one.as_py()
            held.setdefault(name, []).append(rows)
            size[name] = size.get(name, 0) + rows.nbytes
            if size[name] >= SHARD_BYTES:
                yield from give(name)
        while sum(size.values()) > 4 * SHARD_BYTES:
            yield from give(max(size, key=size.get))
    for name in list(held):
        yield from give(name)


class Bitmaps:
    """The bitmaps of the words idx of a shard, which are numbered 0 to V - 1 in that order."""

    def __init__(self, blob: bytes, idx: np.ndarray):
        t = unpack(blob)
        word, block, mask = t.column("word").to_numpy(), np.cumsum(t.column("step").to_numpy(), dtype=np.int64), t.column("mask").to_numpy()
        self.blocks, self.v = (int(block.max()) if len(block) else 0) + 2, len(idx)
        own = np.full(int(max(word.max(initial=-1), idx.max(initial=-1))) + 1, -1, np.int64)
        own[idx] = np.arange(len(idx))
        word = own[word]
        keep = word >= 0
        order = np.flatnonzero(keep)[np.argsort(word[keep], kind="stable")]
        self.word, self.block, self.mask = word[order], block[order], mask[order]
        self.key = self.word * self.blocks + self.block
        self.at = np.full(self.blocks << 6, -1, np.int32)
        for i in range(0, len(self.word), ENTRIES):
            e, pos = _bits(self.block[i : i + ENTRIES], self.mask[i : i + ENTRIES])
            self.at[pos] = self.word[i : i + ENTRIES][e]

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All bitmaps, some whole ones at a time."""
        cut = _runs(self.word) if len(self.word) else np.zeros(0, int)
        i = 0
        while i < len(self.word):
            j = np.searchsorted(cut, i + ENTRIES)
            end = int(cut[j]) if j < len(cut) else len(self.word)
            yield self.word[i:end], self.block[i:end], self.mask[i:end]
            i = end

    def shift(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps one position on; the last bit of a block goes to the next one."""
        over = np.flatnonzero(mask >> np.uint64(63))
        p, b = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1])
        m = np.concatenate([mask << np.uint64(1), np.ones(len(over), np.uint64)])
        order = np.argsort(p * self.blocks + b, kind="stable")
        p, b, m = p[order], b[order], m[order]
        start = _runs(p, b)
        p, b, m = p[start], b[start], np.bitwise_or.reduceat(m, start) if len(start) else m
        return p[m != 0], b[m != 0], m[m != 0]

    def extend(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """ANDs shifted bitmaps of phrases with those of the words that may follow: of each longer phrase its shorter one,
        its last word and its count; and its bitmap, as (longer phrase, block, mask)."""
        e, pos = _bits(block, mask)
        w = self.at[pos].astype(np.int64)
        e, w = e[w >= 0], w[w >= 0]
        key = phrase[e] * self.v + w
        order = np.argsort(key, kind="stable")
        e, w, key = e[order], w[order], key[order]
        one = _runs(key, e)
        e, w, key = e[one], w[one], key[one]
        b = block[e]
        both = mask[e] & self.mask[np.searchsorted(self.key, w * self.blocks + b)]
        start = _runs(key) if len(key) else np.zeros(0, int)
        n = np.add.reduceat(np.bitwise_count(both).astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        longer = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        return phrase[e[start]], w[start], n, longer, b, both


def _cat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _phrases(blob: pa.Table, own: pa.Table) -> pa.Table:
    """ab, c, n: the counts of all phrases of two (c is -1) and three frequent words of a shard, by the words' numbers in
    the corpus. A batch of first words is extended to its end before the next one."""
    ab_, c_, n_ = [], [], []
    if len(blob) and len(own):
        idx, number = own.column("idx").to_numpy(), own.column("id").to_numpy()
        order = np.argsort(number)
        maps, number = Bitmaps(blob.column("blob")[0].as_py(), idx[order]), number[order]
        for batch in maps.batches():
            p, w, n, *longer = maps.extend(*maps.shift(*batch))
            ab = number[p] << 32 | number[w]
            q, c, m, *_ = maps.extend(*maps.shift(*longer))
            ab_ += [ab, ab[q]]
            c_ += [np.full(len(p), -1, np.int32), number[c].astype(np.int32)]
            n_ += [n, m]
        del maps
    out = []
    for parts, kind in ((ab_, np.int64), (c_, np.int32), (n_, np.int64)):
        out.append(pa.array(_cat(parts).astype(kind, copy=False)))
        parts.clear()
    return pa.table(out, names=["ab", "c", "n"])


def _score(a: str, left: str, right: str) -> Column:
    big = lambda c: f"cast({c} AS decimal(38, 0))"
    return F.expr(f"({big(SCALE)} * {big(a)} * {big(a)}) div ({big(left)} * {big(right)})")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (the counts of the two parts of the lowest cut), n (words of the
    language), score."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter("text IS NOT NULL")
    rows = stored(texts.mapInArrow(lean(_gather), _SHARD), "phrases-shards")
    blobs, local = rows.filter("idx < 0").select("shard", "blob"), rows.filter("idx >= 0").select("shard", "lang", "idx", "word", "n")
    total = stored(local.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrases-words")
    sizes = stored(total.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-sizes")
    f1 = stored(ranked(total.filter(F.col("f") >= min_count), F.desc("f"), F.asc("lang"), F.asc("word"), name="id", start=0), "phrases-frequent")
    own = local.join(f1, ["lang", "word"]).select("shard", "idx", "id").toDF("to", "idx", "id")
    counted = blobs.groupBy("shard").cogroup(own.groupBy("to")).applyInArrow(lean(_phrases), "ab long, c int, n long")
    found = stored(counted.groupBy("ab", "c").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count), "phrases-found")
    found_ab = found.select(F.shiftright("ab", 32).alias("a"), F.col("ab").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), F.col("c").cast("long").alias("c"), "f")
    f2, f3 = found_ab.filter("c < 0").drop("c"), found_ab.filter("c >= 0")
    discard(rows, total)

    word = lambda x: small(f1.select(F.col("id").alias(x), F.col("word").alias(f"w{x}"), F.col("f").alias(f"f{x}"), F.col("lang").alias(f"lang{x}")))
    two = lambda x, y: small(f2.select(F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(f"f{x}{y}")))
    inside = f3.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "f").groupBy("p.a", "p.b").agg(F.max("f").alias("longer"))
    short = f2.join(inside, ["a", "b"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f")))
    short = short.join(word("a"), "a").join(word("b"), "b")
    short = short.select(F.col("langa").alias("lang"), F.concat_ws(" ", "wa", "wb").alias("phrase"), F.col("f").alias("a"), F.col("fa").alias("l"), F.col("fb").alias("r"))
    long = f3.join(word("a"), "a").join(word("b"), "b").join(word("c"), "c").join(two("a", "b"), ["a", "b"]).join(two("b", "c"), ["b", "c"])
    long = long.withColumns({"s1": _score("f", "fa", "fbc"), "s2": _score("f", "fab", "fc")})
    first = F.col("s1") <= F.col("s2")
    long = long.select(
        F.col("langa").alias("lang"), F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("f").alias("a"),
        F.when(first, F.col("fa")).otherwise(F.col("fab")).alias("l"), F.when(first, F.col("fbc")).otherwise(F.col("fc")).alias("r"),
    )
    out = short.unionByName(long).withColumn("score", _score("a", "l", "r")).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for keys in (["lang", "salt"], ["lang"]):
        out = out.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.join(small(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
