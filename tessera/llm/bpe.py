"""BPE encoding and decoding through a table of distinct words.

Documents are dealt to blocks once, as compressed Arrow batches. Each block names its distinct words to the parts of a
word table, in which every distinct word is encoded once; the ids go back to the blocks that have the word, where they
are joined to the positions of the texts. Only words travel, not their occurrences, and texts travel once.
Decoding joins ids to the pieces of the vocabulary, whose size is fixed.

Words are those of byte-level BPE with the usual pattern; special tokens of the tokenizer file that stand in a text are
words of their own, as the tokenizers library takes them.

Defined cases: a null text is encoded as an empty one; a very long text is encoded whole, in the one task that has its
block; rows that repeat give repeated results; ids that no piece has raise an error on decoding; an empty table gives an
empty result; the columns to keep are named and may have any names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tokens
from .blocks import block_keys, deal, n_blocks, n_parts, shrunk, unpack
from .lean import lean, small_batches

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARKS = frozenset(",.;:!?")


def special_tokens(tokenizer: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in json.loads(tokenizer).get("added_tokens", []) if x["special"]}


class Splitter:
    """Words of texts, special tokens among them.

    A space between two characters that are no white space begins a word, and what follows up to the next such space is
    split the same wherever it stands. Texts are therefore cut at spaces, and each distinct piece is split once."""

    def __init__(self, special: dict[str, int]):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")").split if special else None
        self.beside = re.compile(r" (?:\s|(?<=\s ))").search

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(x in text for x in self.special):
            return self.find(text)
        return reduce(lambda a, x: a + ([x] if x in self.special else self.find(x)), self.cut(text), [])

    def is_even(self, text: str) -> bool:
        """Whether the text can be cut at all its spaces."""
        return not (text[:1] == " " or text[-1:] == " " or self.beside(text) or any(x in text for x in self.special))

    def after_space(self, piece: str) -> list[str]:
        """Words of a piece with its space; most pieces are letters and at most one mark."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1:] in _MARKS and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.find(" " + piece)


_SPACE = np.zeros(256, bool)
_SPACE[32] = True
_FIRST = np.uint64(0x3C79AC492BA7B653)


_HASH = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct hashes, and which of them each one is."""
    _, at, number = np.unique(h["a"], return_index=True, return_inverse=True)
    if (h["b"] == h["b"][at][number]).all():  # the first halves tell all apart
        return at, number
    _, at, number = np.unique(h, return_index=True, return_inverse=True)
    return at, number


class Cut:
    """The texts of a block, cut into numbered pieces; each distinct piece is split into words once. Pieces are told apart
    by 128-bit hashes."""

    def __init__(self, tables: list[pa.Table], split: Splitter):
        self.split = split
        self.even, self.counts, self.whole, self.parts = [], [], [], []
        hashes, found, whole = [], [], {}
        for table in tables:
            column = table.column("text").combine_chunks()
            texts = [t or "" for t in column.to_pylist()]
            even = np.array([split.is_even(t) for t in texts], bool)
            self.whole.append(np.array([whole.setdefault(t, len(whole)) for t, e in zip(texts, even, strict=True) if not e], np.int64))
            del texts
            count = np.ones(len(even), np.int64)
            cut = column.filter(pa.array(even))
            per = []
            for a, b in tokens.slices(cut, 1_000_000):
                buf, off = tokens.buffer(cut.slice(a, b - a))
                w = tokens.split(buf, off, _SPACE)
                h = np.empty(len(w.start), _HASH)
                h["a"], h["b"] = tokens.hashes(buf, w), tokens.hashes(buf, w, 1)
                first = w.ptr[:-1][np.diff(w.ptr) > 0]
                h["a"][first] ^= _FIRST  # a text's first piece has no space before it
                # only distinct pieces of the slice are kept
                at, number = _distinct(h)
                hashes.append(h[at])
                found.append((buf, w.start[at].astype(np.int32), w.end[at].astype(np.int32), np.isin(at, first)))
                self.parts.append(number.astype(np.int32))
                per.append(np.diff(w.ptr))
            count[even] = np.concatenate(per) if per else 0
            self.even.append(even)
            self.counts.append(count)
        at, number = _distinct(np.concatenate(hashes) if hashes else np.zeros(0, _HASH))
        end = np.cumsum([len(h) for h in hashes])
        self.parts = [n[x].astype(np.int32) for n, x in zip(np.split(number, end[:-1]) if hashes else [], self.parts, strict=True)]
        self.pieces, self.first = [""] * len(at), np.zeros(len(at), bool)
        order = np.argsort(at)
        cuts = np.searchsorted(at[order], end)
        for (buf, start, stop, first), k, lo, hi, base in zip(found, range(len(found)), [0, *cuts[:-1]], cuts, [0, *end[:-1]], strict=True):
            for n in order[lo:hi].tolist():
                i = at[n] - base
                self.pieces[n] = buf[start[i] : stop[i]].tobytes().decode()
            self.first[order[lo:hi]] = first[at[order[lo:hi]] - base]
            found[k] = None  # type: ignore[call-overload]
        self.texts, self.n = list(whole), len(self.pieces)

    def words(self) -> Iterator[list[str]]:
        """The words of each piece: of number 0, 1, ..., and then those of texts that could not be cut."""
        find, after = self.split.find, self.split.after_space
        for piece, first in zip(self.pieces, self.first.tolist(), strict=True):
            yield find(piece) if first else after(piece)
        for text in self.texts:
            yield self.split(text)

    def numbers(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per table: pieces of each text, and their numbers one after another."""
        every = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        done = 0
        for even, count, whole in zip(self.even, self.counts, self.whole, strict=True):
            inside = np.repeat(even, count)
            out = np.empty(len(inside), np.int32)
            n = int(inside.sum())
            out[inside] = every[done : done + n]
            out[~inside] = self.n + whole
            done += n
            yield count, out


def byte_of_char() -> dict[str, int]:
    """The character by which byte-level BPE writes each byte: itself if printable, else one from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """The vocabulary as a table from id to bytes."""

    def __init__(self, tokenizer: str):
        spec, of = json.loads(tokenizer), byte_of_char()
        piece = {i: bytes(of[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        piece |= {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
        size = np.zeros(max(piece) + 1, np.int64)
        for i, x in piece.items():
            size[i] = len(x)
        self.size, self.start = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(piece.get(i, b"") for i in range(len(size))), np.uint8)
        self.known = np.isin(np.arange(len(size)), list(piece))

    def decode(self, ids: np.ndarray, ptr: np.ndarray) -> list[str]:
        """Texts of ids[ptr[i]:ptr[i + 1]]."""
        if len(ids) and (int(ids.max()) >= len(self.size) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for i in range(len(ptr) - 1):
            x = ids[ptr[i] : ptr[i + 1]]
            n = self.size[x]
            at = np.repeat(self.start[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append(self.data[at].tobytes().decode("utf-8", "replace"))
        return out


def _by_part(words: list[str], n: int) -> list[np.ndarray]:
    """Places of words by part of the word table, which a hash of their bytes chooses; in each part in order."""
    buf, off = tokens.buffer(pa.array(words, pa.string()))
    h = tokens.hashes(buf, tokens.Words(off[:-1], off[1:], off))
    part = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, n)))


@lru_cache(maxsize=1)
def _encoder(tokenizer: str):
    """Words to packed ids; a worker loads a tokenizer once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer)
    tok.no_truncation()
    tok.no_padding()
    return getattr(tok, "encode_batch_fast", tok.encode_batch)  # without offsets, where there is that


@lru_cache(maxsize=1)
def _pieces(tokenizer: str) -> Pieces:
    return Pieces(tokenizer)


def _name_words(special: dict[str, int], keys: list[int]):
    """Blocks to (p, k, words): the distinct words of a block, in order, a row for each part of the word table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, blocks = Splitter(special), {}
        for batch in batches:
            for k, blob in zip(batch.column("k").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blocks.setdefault(k, []).append(blob)
        while blocks:
            k, blobs = blocks.popitem()
            mine: set[str] = set()
            for words in Cut([unpack(b) for b in blobs], split).words():
                mine.update(words)
            ordered = sorted(mine)
            column = pa.array(ordered, pa.string())
            for p, at in enumerate(_by_part(ordered, len(keys))):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[p]], pa.int32()), pa.array([k], pa.int32()), pa.array([shrunk(word=column.take(pa.array(at)))], pa.binary())], ["p", "k", "words"])

    return lean(run)


def _encode_words(held):
    """A part of the word table: rows (p, k, words) to (k, p, ids). Each distinct word is encoded once, when the first
    block asks for it; a part has its share of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_batch = _encoder(held.value)
        known: dict[str, bytes] = {}
        for batch in batches:
            for p, k, blob in zip(batch.column("p").to_pylist(), batch.column("k").to_pylist(), batch.column("words"), strict=True):
                words = unpack(blob.as_py()).column("word").to_pylist()
                new = [w for w in words if w not in known]
                for w, e in zip(new, encode_batch(new, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.uint32).tobytes()
                got = [known[w] for w in words]
                ids = shrunk(ids=pa.array(np.frombuffer(b"".join(got), np.uint32)))
                sizes = shrunk(n=pa.array(np.array([len(x) // 4 for x in got], np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([p], pa.int32()), pa.array([ids], pa.binary()), pa.array([sizes], pa.binary())], ["k", "p", "ids", "sizes"])

    return lean(run)


def _join_positions(held, special: dict[str, int], keys: list[int], fields: pa.Schema):
    def run(blobs: pa.Table, words: pa.Table) -> pa.Table:
        pieces, split = _pieces(held.value), Splitter(special)
        names: dict[str, int] = {}
        flat: list[int] = []
        ptr: list[int] = [0]
        tables = [unpack(b.as_py()) for b in blobs.column("blob")]
        cut = Cut(tables, split)
        name = names.setdefault
        for words_ in cut.words():
            flat += [name(w, len(names)) for w in words_]
            ptr.append(len(flat))
        cut.pieces = cut.texts = []
        parts = [(rows.drop_columns(["text"]), count, numbers) for rows, (count, numbers) in zip(tables, cut.numbers(), strict=True)]
        tokens_, token_ptr = np.array(flat, np.int64), np.array(ptr, np.int64)
        del flat, ptr, cut, tables
        # ids of the block's words, as they came: by part of the word table, in order
        reply = {p: (i.as_py(), n.as_py()) for p, i, n in zip(words.column("p").to_pylist(), words.column("ids"), words.column("sizes"), strict=True)}
        flat_, size_, at = [], [], np.full(len(names), -1, np.int64)
        n = 0
        ordered = sorted(names)
        number = np.array([names[w] for w in ordered], np.int64)
        for p, mine in enumerate(_by_part(ordered, len(keys))):
            if not len(mine):
                continue
            ids, sizes = (next(iter(unpack(x).columns)).to_numpy() for x in reply.pop(keys[p]))
            if len(sizes) != len(mine):
                raise RuntimeError("a block and its words do not fit")
            at[number[mine]] = np.arange(n, n + len(mine))
            flat_.append(ids)
            size_.append(sizes)
            n += len(mine)
        names.clear()
        flat = np.concatenate(flat_) if flat_ else np.zeros(0, np.uint32)
        size = np.concatenate(size_).astype(np.int64) if size_ else np.zeros(0, np.int64)
        off = np.cumsum(size) - size
        out = []
        while parts:
            rows, count, numbers = parts.pop()
            many = token_ptr[numbers + 1] - token_ptr[numbers]
            w = at[tokens_[np.repeat(token_ptr[numbers] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]]
            count = np.diff(np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(count)])])
            k = size[w]
            got = flat[np.repeat(off[w] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            ptr = np.concatenate([[0], np.cumsum(k)])[np.concatenate([[0], np.cumsum(count)])]
            packed = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer((ptr * 4).astype(np.int64)), pa.py_buffer(got.astype("<u4"))]).cast(pa.binary())
            out.append(pa.Table.from_arrays([*rows.columns, pa.array(np.diff(ptr), pa.int64()), packed, pa.array(pieces.decode(got, ptr), pa.string())], schema=fields))
        return pa.concat_tables(out) if out else fields.empty_table()

    return lean(run)


def encode(docs: DataFrame, tokenizer: str, keep: list[str], n_tokens: str = "n_tokens", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The columns named in `keep`, and of each text: the number of its ids, the ids as little-endian unsigned 32-bit
    integers, and what they decode to. tokenizer: the JSON text of a byte-level BPE of the tokenizers library."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    special, held = special_tokens(tokenizer), spark.sparkContext.broadcast(tokenizer)
    small_batches(spark)
    many = n_blocks(docs)
    n = n_parts(spark, many)
    own = [f"c{i}" for i in range(len(keep))]
    keys = block_keys(spark, n)
    blocks = deal(docs, keep, own, block_keys(spark, many))
    words = blocks.mapInArrow(_name_words(special, keys), "p int, k int, words binary")
    encoded = words.repartition(n, "p").mapInArrow(_encode_words(held), "k int, p int, ids binary, sizes binary").repartition(many, "k")
    made = [T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    schema = T.StructType([*(T.StructField(o, docs.schema[c].dataType) for c, o in zip(keep, own, strict=True)), *made])
    fields = to_arrow_schema(schema)
    out = blocks.groupBy("k").cogroup(encoded.groupBy("k")).applyInArrow(_join_positions(held, special, keys, fields), schema)
    return out.toDF(*keep, n_tokens, ids, decoded)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text that packed ids stand for; null stays null."""
    held = df.sparkSession.sparkContext.broadcast(tokenizer)
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(held.value)
        for batch in batches:
            packed = batch.column(names.index(ids)).to_pylist()
            each = [np.frombuffer(x or b"", np.uint32) for x in packed]
            ptr = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            got = pieces.decode(np.concatenate(each) if each else np.zeros(0, np.uint32), ptr)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if p is None else g for p, g in zip(packed, got, strict=True)], pa.string())], [*names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))
