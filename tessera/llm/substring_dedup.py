"""Removes repeats of long word sequences, found by recompression.

Texts are rewritten in rounds. A round first replaces each run of one symbol by a symbol for the run, then each pair of
adjacent symbols whose left one is on the left and whose right one is on the right side of a hashed split of the alphabet
by a symbol for the pair. New symbols are named by a hash of their parts, the same in every task, so equal substrings get
equal symbols except near their ends. Each symbol carries the range of words on which it depends; a symbol that occurs
once in the whole corpus shows that no window around its range is repeated. What is left are the long repeats with few
others, and the hashes of those windows decide which window starts first.

Only distinct symbols and window hashes of a block of texts travel, and one bit comes back for each: whether the symbol
occurs elsewhere, and whether a window's first place in the block is its first place in the corpus. No task gets a group
larger than one entry per block, however often a passage repeats.

Places are ordered by doc_id, null last, then by position. Window hashes have 96 bits.

Defined cases: null texts have no words and an empty rest; texts shorter than a window stay; a very long text is held
whole by the one task that has its block; of rows that repeat a doc_id,
a window at the same position in two of them precedes neither, so repeated rows are kept or cut alike; an empty table
gives an empty result; the columns to keep may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tokens
from .blocks import block_keys, deal, n_blocks, n_parts, shrunk, unpack
from .lean import lean, small_batches

WIDTH = 20
ROUNDS = 3
_G = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << 40
#: Bits of a symbol's name that travel; equal names of different symbols only cost a useless window hash.
NAME_BITS = 48


def _beside(first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range bounds of the symbols to the left and to the right; beyond a text's end nothing can be known."""
    left, right = np.full(len(low), -_FAR), np.full(len(high), _FAR)
    left[1:] = np.where(first[1:], -_FAR, low[:-1])
    right[:-1] = np.where(last[:-1], _FAR, high[1:])
    return left, right


def recompress(h: np.ndarray, ptr: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts h[ptr[i]:ptr[i + 1]] after some rounds: names, and the ranges of words that they depend on."""
    n = len(h)
    text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    name, low, high = tokens.mix(h + _G), np.arange(n), np.arange(1, n + 1)
    for k in range(rounds):
        if not len(name):
            break
        # runs
        first, last = np.ones(len(name), bool), np.ones(len(name), bool)
        first[1:] = text[1:] != text[:-1]
        last[:-1] = first[1:]
        left, right = _beside(first, last, low, high)
        begin = first.copy()
        begin[1:] |= name[1:] != name[:-1]
        at = np.flatnonzero(begin)
        size = np.diff(np.append(at, len(name)))
        end = at + size - 1
        run = tokens.mix(name[at] * _G + size.astype(np.uint64) + np.uint64(k))
        # where a run begins and ends depends on the symbols beside it
        name, low, high, text = np.where(size > 1, run, name[at]), np.minimum(low[at], left[at]), np.maximum(high[end], right[end]), text[at]
        # pairs
        first, last = np.ones(len(name), bool), np.ones(len(name), bool)
        first[1:] = text[1:] != text[:-1]
        last[:-1] = first[1:]
        left, right = _beside(first, last, low, high)
        on_left = (tokens.mix(name + np.uint64(1000 + k)) >> np.uint64(63)) == 1
        opens = np.zeros(len(name), bool)
        opens[:-1] = on_left[:-1] & ~on_left[1:] & ~last[:-1]
        stays = np.ones(len(name), bool)
        stays[1:] = ~opens[:-1]
        at = np.flatnonzero(stays)
        pair, other = opens[at], np.minimum(at + 1, len(name) - 1)
        joined = tokens.mix(name[at] * _G ^ name[other] + np.uint64(k + 7))
        # a symbol that is not paired depends on the neighbour that it could have been paired with
        low, high = np.where(pair | on_left[at], low[at], np.minimum(low[at], left[at])), np.where(pair, high[other], np.where(on_left[at], np.maximum(high[at], right[at]), high[at]))
        name, text = np.where(pair, joined, name[at]), text[at]
    return name >> np.uint64(64 - NAME_BITS), low, high


class Texts:
    """Words of a column of texts, their windows, and the symbols that lie inside of windows."""

    def __init__(self, column: pa.Array, width: int, rounds: int):
        self.buf, off = tokens.buffer(column)
        self.w = tokens.split(self.buf, off)
        self.ptr = self.w.ptr
        self.h = tokens.hashes(self.buf, self.w)
        self.row = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        self.width, n = width, len(self.h)
        self.names, self.low, self.high = recompress(self.h, self.ptr, rounds)
        inside = (self.low >= 0) & (self.high <= n) & (self.high - self.low <= width)
        self.names, self.low, self.high = self.names[inside], self.low[inside], self.high[inside]
        many = max(0, n - width + 1)
        self.whole = self.row[:many] == self.row[n - many :] if many else np.zeros(0, bool)

    def candidates(self, once: np.ndarray) -> np.ndarray:
        """Starts of windows without a symbol that occurs only once; once: a flag per symbol."""
        n = len(self.h)
        step = np.bincount(np.maximum(self.high[once] - self.width, 0), minlength=n + 1) - np.bincount(self.low[once] + 1, minlength=n + 1)[: n + 1]
        return np.flatnonzero((np.cumsum(step)[: len(self.whole)] == 0) & self.whole)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes, of 64 and of 32 bits, of the windows that start at the given words."""
        a, b = np.zeros(len(at), np.uint64), np.full(len(at), np.uint64(0x5851F42D4C957F2D))
        for k in range(self.width):
            x = self.h[at + k]
            a = tokens.mix(a * _G + x + np.uint64(k + 1))
            b = (b ^ x) * np.uint64(0xD6E8FEB86659FD93) + (b >> np.uint64(29))
        return a, (tokens.mix(b) >> np.uint64(32)).astype(np.uint32)


def _part(x: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Which of n parts has a hash: parts are ranges of it."""
    return ((x >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _steps(x: np.ndarray) -> dict[str, pa.Array]:
    """Sorted numbers as differences, in halves, which compress well."""
    d = np.diff(x, prepend=np.uint64(0))
    return {"lo": pa.array(d.astype(np.uint32)), "hi": pa.array((d >> np.uint64(32)).astype(np.uint32))}


def _from_steps(t: pa.Table) -> np.ndarray:
    d = t.column("lo").to_numpy().astype(np.uint64) | t.column("hi").to_numpy().astype(np.uint64) << np.uint64(32)
    return np.cumsum(d, dtype=np.uint64)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _flags(reply: pa.Table, keys: list[int], sizes: list[int]) -> np.ndarray:
    """The bits that came back for a block's entries, which were sent part after part."""
    by = dict(zip(reply.column("p").to_pylist(), reply.column("bits").to_pylist(), strict=True))
    got = [np.unpackbits(np.frombuffer(by[keys[p]], np.uint8), count=n).astype(bool) for p, n in enumerate(sizes) if n]
    return np.concatenate(got) if got else np.zeros(0, bool)


def _slices(blobs: pa.ChunkedArray) -> Iterator[tuple[pa.Table, pa.Array]]:
    for blob in blobs:
        rows = unpack(blob.as_py())
        column = rows.column("text").combine_chunks()
        for i, j in tokens.slices(column):
            yield rows.slice(i, j - i), column.slice(i, j - i)


def _block_names(blobs: pa.ChunkedArray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct symbols of a block, sorted, and whether each occurs twice or more there."""
    names, twice = np.zeros(0, np.uint64), np.zeros(0, bool)
    for _, column in _slices(blobs):
        x, count = np.unique(Texts(column, width, rounds).names, return_counts=True)
        both = np.concatenate([names, x])
        again = np.concatenate([twice, count > 1])
        order = np.argsort(both, kind="stable")
        both, again = both[order], again[order]
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        start = np.flatnonzero(new)
        names = both[start]
        twice = (np.logical_or.reduceat(again, start) | (np.diff(np.append(start, len(both))) > 1)) if len(start) else np.zeros(0, bool)
    return names, twice


def _ask_symbols(keys: list[int], width: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        for batch in batches:
            for k, blob in zip(batch.column("k").to_pylist(), batch.column("blob"), strict=True):
                blocks.setdefault(k, []).append(blob)
        while blocks:
            k, blobs = blocks.popitem()
            names, twice = _block_names(blobs, width, rounds)
            cut = np.searchsorted(_part(names, NAME_BITS, len(keys)), np.arange(len(keys) + 1))
            for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[p]], pa.int32()), pa.array([k], pa.int32()), pa.array([shrunk(**_steps(names[a:b]), twice=pa.array(twice[a:b]))], pa.binary())], ["p", "k", "entries"])

    return lean(run)


def _count_symbols(group: pa.Table) -> pa.Table:
    """A part of all symbols: per block, which of its symbols occur twice or more in the corpus."""
    tables = [unpack(x.as_py()) for x in group.column("entries")]
    names = [_from_steps(t) for t in tables]
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    x = every[order]
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(np.append(start, len(x)))
    twice = np.concatenate([t.column("twice").to_numpy() for t in tables])[order]
    more = np.empty(len(x), bool)
    more[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice, start), size)
    cut = np.cumsum([len(n) for n in names])[:-1]
    return pa.table({"k": group.column("k"), "p": group.column("p"), "bits": pa.array([_bits(b) for b in np.split(more, cut)], pa.binary())})


class Found:
    """The candidate windows of a block: per distinct hash its first place, and where all of them are."""

    def __init__(self, blobs: pa.ChunkedArray, reply: pa.Table, keys: list[int], width: int, rounds: int):
        self.parts = [(rows, Texts(column, width, rounds)) for rows, column in _slices(blobs)]
        names = np.unique(np.concatenate([t.names for _, t in self.parts])) if self.parts else np.zeros(0, np.uint64)
        cut = np.searchsorted(_part(names, NAME_BITS, len(keys)), np.arange(len(keys) + 1))
        repeated = _flags(reply, keys, np.diff(cut).tolist())
        self.many, a_, b_, doc_, at_, row_ = [], [], [], [], [], []
        for rows, t in self.parts:
            start = t.candidates(~repeated[np.searchsorted(names, t.names)])
            del t.names, t.low, t.high
            a, b = t.windows(start)
            row = t.row[start]
            ids = rows.column("order").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
            a_.append(a)
            b_.append(b)
            doc_.append(ids[row])
            at_.append(start - t.ptr[row])
            row_.append(row)
            del t.h, t.row
            self.many.append(len(start))
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.a, self.b, self.doc, self.at = cat(a_, np.uint64), cat(b_, np.uint32), cat(doc_, np.int64), cat(at_, np.int64)
        self.row = cat(row_, np.int64)  # in the slice of texts
        order = np.lexsort((self.at, self.doc, self.b, self.a))
        a, b = self.a[order], self.b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first = order[new]  # the first place of each distinct window, windows in order of their hashes
        self.window = np.empty(len(a), np.int64)
        self.window[order] = np.cumsum(new) - 1
        self.cut = np.searchsorted(_part(self.a[self.first], 64, len(keys)), np.arange(len(keys) + 1))


def _ask_windows(keys: list[int], width: int, rounds: int):
    def run(key: tuple, blobs: pa.Table, reply: pa.Table) -> pa.Table:
        f = Found(blobs.column("blob"), reply, keys, width, rounds)
        p_, e_ = [], []
        for p, (a, b) in enumerate(zip(f.cut[:-1], f.cut[1:], strict=True)):
            if b > a:
                x = f.first[a:b]
                p_.append(keys[p])
                e_.append(shrunk(**_steps(f.a[x]), b=pa.array(f.b[x]), doc=pa.array(f.doc[x]), at=pa.array(f.at[x].astype(np.int32))))
        return pa.table({"p": pa.array(p_, pa.int32()), "k": pa.array([key[0].as_py()] * len(p_), pa.int32()), "entries": pa.array(e_, pa.binary())})

    return lean(run)


def _first_windows(group: pa.Table) -> pa.Table:
    """A part of all windows: per block, for which of its windows its first place is the first of all."""
    tables = [unpack(x.as_py()) for x in group.column("entries")]
    a, b = np.concatenate([_from_steps(t) for t in tables]), np.concatenate([t.column("b").to_numpy() for t in tables])
    doc, at = np.concatenate([t.column("doc").to_numpy() for t in tables]), np.concatenate([t.column("at").to_numpy() for t in tables])
    order = np.lexsort((at, doc, b, a))
    x, y = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    head = order[np.repeat(start, np.diff(np.append(start, len(x))))]
    first = np.empty(len(x), bool)
    first[order] = (doc[order] == doc[head]) & (at[order] == at[head])
    cut = np.cumsum([len(t) for t in tables])[:-1]
    return pa.table({"k": group.column("k"), "p": group.column("p"), "bits": pa.array([_bits(f) for f in np.split(first, cut)], pa.binary())})


def _cut(keys: list[int], width: int, rounds: int, fields: pa.Schema):
    def run(blobs: pa.Table, replies: pa.Table) -> pa.Table:
        kind = replies.column("kind").to_numpy()
        f = Found(blobs.column("blob"), replies.filter(pa.array(kind == 0)), keys, width, rounds)
        ours = _flags(replies.filter(pa.array(kind == 1)), keys, np.diff(f.cut).tolist())
        head = f.first[f.window]
        later = ~ours[f.window] | (f.doc != f.doc[head]) | (f.at != f.at[head])
        out, n = [], 0
        for (rows, t), many in zip(f.parts, f.many, strict=True):
            buf, w = t.buf, t.w
            gone = np.zeros(len(w.start) + 1, np.int64)
            hit = later[n : n + many]
            at = w.ptr[f.row[n : n + many][hit]] + f.at[n : n + many][hit]
            n += many
            np.add.at(gone, at, 1)
            np.add.at(gone, at + width, -1)
            removed = np.cumsum(gone)[:-1] > 0
            out.append(_rest(rows, buf, w, removed, fields))
        return pa.concat_tables(out) if out else fields.empty_table()

    return lean(run)


def _rest(rows: pa.Table, buf: np.ndarray, w: tokens.Words, removed: np.ndarray, fields: pa.Schema) -> pa.Table:
    """Columns kept, and n_words, n_removed, the kept words joined by a space, and the removed ranges."""
    n = np.diff(w.ptr)
    row = np.repeat(np.arange(len(n)), n)
    stay = np.flatnonzero(~removed)
    size = w.end[stay] - w.start[stay]
    last = np.ones(len(stay), bool)
    last[:-1] = row[stay][1:] != row[stay][:-1]
    room = size + ~last  # a space after all but the last word of a text
    to = np.cumsum(room) - room
    text = np.full(int(room.sum()), 32, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(to, size) + inner] = buf[np.repeat(w.start[stay], size) + inner]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[stay], room, len(n)))]).astype(np.int64)
    kept = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(text)]).cast(pa.string())
    begin = removed.copy()
    begin[1:] &= ~(removed[:-1] & (row[1:] == row[:-1]))
    end = removed.copy()
    end[:-1] &= ~(removed[1:] & (row[1:] == row[:-1]))
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    spans = pa.StructArray.from_arrays([pa.array((b - w.ptr[row[b]]).astype(np.int32)), pa.array((e - b).astype(np.int32))], ["first_word", "n_words"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[b], minlength=len(n)))]).astype(np.int32)
    n_removed = np.bincount(row, removed, len(n)).astype(np.int64)
    columns = [rows.column(c) for c in rows.column_names if c not in ("text", "order")]
    return pa.Table.from_arrays([*columns, pa.array(n), pa.array(n_removed), kept, pa.ListArray.from_arrays(pa.array(offsets), spans)], schema=fields)


def dedup_substrings(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """The columns named in `keep`, and n_words, n_removed, kept (the words that stay, joined by a space) and removed
    (ranges of words). doc_id: an integer column that orders the documents."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    many = n_blocks(docs)
    n = n_parts(spark, many)
    keys = block_keys(spark, n)
    own = [f"c{i}" for i in range(len(keep))]
    ordered = docs.select(*(docs[f"`{c}`"].alias(o) for c, o in zip(keep, own, strict=True)), docs[f"`{doc_id}`"].cast("long").alias("order"), docs["text"].alias("text"))
    blocks = deal(ordered, [*own, "order"], [*own, "order"], block_keys(spark, many))
    reply = "k int, p int, bits binary"
    symbols = blocks.mapInArrow(_ask_symbols(keys, width, rounds), "p int, k int, entries binary").repartition(n, "p").groupBy("p").applyInArrow(lean(_count_symbols), reply)
    symbols = symbols.repartition(many, "k")
    windows = blocks.groupBy("k").cogroup(symbols.groupBy("k")).applyInArrow(_ask_windows(keys, width, rounds), "p int, k int, entries binary")
    firsts = windows.repartition(n, "p").groupBy("p").applyInArrow(lean(_first_windows), reply)
    both = symbols.selectExpr("k", "p", "bits", "0 AS kind").unionByName(firsts.selectExpr("k", "p", "bits", "1 AS kind")).repartition(many, "k")
    span = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("removed", span)]
    schema = T.StructType([*(T.StructField(o, docs.schema[c].dataType) for c, o in zip(keep, own, strict=True)), *made])
    out = blocks.groupBy("k").cogroup(both.groupBy("k")).applyInArrow(_cut(keys, width, rounds, to_arrow_schema(schema)), schema)
    return out.toDF(*keep, *(x.name for x in made))
