"""Language identification with labelled spans of mixed-language text.

Script ranges narrow the languages that a word can be of; byte trigrams give each word a score per candidate; Viterbi
decoding over the words, with a penalty for each switch of language, labels spans. A text's language is the one that
labels most of its words. Its score is the share of those words, times the odds of the language against the next best one
on the words that it labels.

The model is learned by counting in Spark over at most about `train_rows` labelled texts, chosen by a hash of the text.

Defined cases: a null text and one without a letter (Unicode category L) are `und` with score 0 and have no spans; a text
whose letters are of scripts that no language was learned with gets the commonest language with score 0; languages that
label equally many words go by their total score there, then by code point, as do equal scores of a word; a very long
text is decoded whole, in time and memory that grow with its words times the languages; without any labelled text
everything is `und`; repeated rows are labelled alike; other columns are kept whatever their names.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .lean import lean, small_batches

TRAIN_ROWS = 20_000
BUCKETS = 1 << 16
SWITCH = 12.0
PIECE = 256
#: Bytes of texts times languages, eight at least, that are labelled at a time.
SLICE = 16_000_000
#: Bytes of words whose trigrams are looked up at a time.
STRETCH = 2_000_000
UNDETERMINED = "und"

#: First code points of blocks and the script that holds from there to the next one.
SCRIPTS = [
    (0x0000, "Common"), (0x0041, "Latin"), (0x0250, "Latin"), (0x02B0, "Common"), (0x0370, "Greek"), (0x0400, "Cyrillic"),
    (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Other"),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2E00, "Common"),
    (0x2E80, "Han"), (0x3000, "Common"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "Common"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Common"),
    (0xF900, "Han"), (0xFB00, "Other"), (0xFB50, "Arabic"), (0xFE00, "Common"), (0xFE70, "Arabic"), (0xFF00, "Common"),
    (0x10000, "Other"), (0x1D400, "Common"), (0x1E900, "Other"), (0x1F000, "Common"), (0x20000, "Han"),
]
SCRIPT_NAMES = list(dict.fromkeys(name for _, name in SCRIPTS))
_FROM = np.array([first for first, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int8)
_COMMON, _LATIN, _OTHER = (SCRIPT_NAMES.index(x) for x in ("Common", "Latin", "Other"))
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@lru_cache(maxsize=1)
def _letter_scripts() -> np.ndarray:
    """By code point the script of a letter, -1 for what is no letter; letters in blocks of no script are of another."""
    every = np.arange(sys.maxunicode + 1)
    script = _SCRIPT[np.searchsorted(_FROM, every, "right") - 1]
    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in every])
    return np.where(letter, np.where(script == _COMMON, _OTHER, script), -1).astype(np.int8)


class Model(NamedTuple):
    languages: list[str]
    score: np.ndarray  # float32, bucket x language
    allowed: np.ndarray  # bool, script x language
    commonest: int


def _lower(buf: np.ndarray) -> np.ndarray:
    out = tokens.fold(buf)
    capital = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)  # Latin-1 capitals
    out[1:][capital] += 32
    return out


def _scripts(buf: np.ndarray, w: tokens.Words) -> np.ndarray:
    """Script of each word, -1 if it has no letter; a script other than Latin goes before Latin."""
    if not len(w.start):
        return np.zeros(0, np.int8)
    mark = np.where(_ASCII_LETTER[buf], 1, 0).astype(np.int8)  # 0 none, 1 Latin, then 2 + script
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
        b0, b1, b2, b3 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
        two, three = (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2
        cp = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        s = _letter_scripts()[cp]
        mark[lead] = np.where(s < 0, 0, np.where(s == _LATIN, 1, s + 2))
    most = np.maximum.reduceat(mark, w.start)
    return np.where(most == 0, -1, np.where(most == 1, _LATIN, most - 2)).astype(np.int8)


def _buckets(buf: np.ndarray, w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """A bucket per byte of every word, for the trigram around it, and where each word's buckets begin."""
    size = w.end - w.start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(w.start - first, size)
    text = np.concatenate([[32], _lower(buf), [32]]).astype(np.uint32)
    before, here, after = text[at], text[at + 1], text[at + 2]
    if len(first):
        before[first] = 32
        after[first + size - 1] = 32
    return ((before * 0x9E3779B1 + here * 0x85EBCA77 + after * 0xC2B2AE3D) >> np.uint32(16)).astype(np.int64), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        for i, j in tokens.slices(batch.column("text")):
            buf, off = tokens.buffer(batch.column("text").slice(i, j - i))
            w = tokens.split(buf, off)
            got, _ = _buckets(buf, w)
            per_word = np.repeat(np.arange(j - i), np.diff(w.ptr))
            per_byte = np.repeat(per_word, w.end - w.start)
            script = _scripts(buf, w)
            for name in dict.fromkeys(lang[i:j]):
                rows = lang[i:j] == name
                a, s = seen.setdefault(name, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
                a += np.bincount(got[rows[per_byte]], minlength=BUCKETS)
                s += np.bincount(script[rows[per_word] & (script >= 0)], minlength=len(SCRIPT_NAMES))
    for name, (a, s) in seen.items():
        both = np.concatenate([a, s])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(both[at], pa.int64())], ["lang", "at", "n"])


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from the columns text and lang."""
    rows = labelled.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    share = train_rows / max(1, labelled.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    counts = rows.mapInArrow(lean(_count), "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique(), key=lambda s: [ord(c) for c in s])
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(names)))
    n[counts["at"].to_numpy(np.int64), counts["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)] = counts["n"]
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    score = np.log((grams + 0.05) / (grams.sum(0) + 0.05 * BUCKETS))
    score = np.maximum(score, score.max(1, keepdims=True) - 8) if names else score
    score -= score.mean(1, keepdims=True) if names else 0
    return Model(names, score.astype(np.float32), scripts >= np.maximum(1, 0.001 * scripts.sum(0)), int(np.argmax(scripts.sum(0))) if names else 0)


def _pieces(e: np.ndarray, ptr: np.ndarray, switch: float, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of pieces that can be labelled each on its own. Texts are cut at words whose best label leads by
    more than two switches, so that they have it whatever is around them; such a word ends a piece and begins the next."""
    if e.shape[1] < 2 or int(np.diff(ptr).max(initial=0)) <= piece:
        has = np.diff(ptr) > 0
        return ptr[:-1][has], ptr[1:][has] - 1
    two = -np.partition(-e, 1, axis=1)[:, :2]
    sure = two[:, 0] - two[:, 1] > 2 * switch
    number = np.arange(len(e)) - np.repeat(ptr[:-1], np.diff(ptr))
    sure &= number > 0
    sure[np.maximum(ptr[1:] - 1, 0)] = False
    at = np.flatnonzero(sure)
    # the first such word in every stretch of `piece` words of a text
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[at]
    stretch = number[at] // piece
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (stretch[1:] != stretch[:-1])
    cut = at[new]
    has = np.diff(ptr) > 0
    return np.sort(np.concatenate([ptr[:-1][has], cut])), np.sort(np.concatenate([cut, ptr[1:][has] - 1]))


def decode(e: np.ndarray, ptr: np.ndarray, switch: float = SWITCH, piece: int = PIECE) -> np.ndarray:
    """Best label of every word: maximises the sum of scores e (word x label) less `switch` for every change of label
    inside a text (words ptr[i]:ptr[i + 1]). As all changes cost the same, a step looks at the best label before and at the
    same one only; texts, or pieces of them, advance in step."""
    k, n = e.shape[1], len(e)
    if k < 2 or not n:
        return np.zeros(n, np.int64)
    lo, last = _pieces(e, ptr, switch, piece)
    length = last - lo + 1
    order = np.argsort(-length, kind="stable")
    lo, length = lo[order], length[order]
    active = np.searchsorted(-length, -np.arange(int(length.max())), "left")  # pieces longer than step t
    v = e[lo].astype(np.float64)
    stays = np.empty((n, k), bool)  # whether the label before is the same
    best = np.empty(n, np.int32 if k > 127 else np.int8)  # and which it is otherwise
    for t in range(1, len(active)):
        x = v[: active[t]]
        at = lo[: active[t]] + t
        top = x.max(1, keepdims=True)
        best[at] = x.argmax(1)
        stays[at] = stay = x >= top - switch
        v[: active[t]] = np.where(stay, x - top, -switch) + e[at]
    got, now = np.zeros(n, np.int64), v.argmax(1)
    for t in range(len(active) - 1, 0, -1):
        at = lo[: active[t]] + t
        own = now[: active[t]]
        got[at] = own
        now[: active[t]] = np.where(stays[at, own], own, best[at])
    got[lo] = now
    return got


def _scores(buf: np.ndarray, w: tokens.Words, model: Model) -> np.ndarray:
    """word x language, from stretches of words, however long the text."""
    e = np.empty((len(w.start), len(model.languages)), np.float32)
    i = 0
    while i < len(e):
        base = w.start[i]
        j = max(i + 1, int(np.searchsorted(w.end, base + STRETCH, "right")))
        got, first = _buckets(buf[base : w.end[j - 1]], tokens.Words(w.start[i:j] - base, w.end[i:j] - base, w.ptr))
        for c in range(e.shape[1]):
            e[i:j, c] = np.add.reduceat(model.score[:, c][got], first)
        i = j
    return e


def _judge(e: np.ndarray, label: np.ndarray, row: np.ndarray, some: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the label of most of its words, -1 if it has none, and the score: the share of those words, times the odds
    of the label against the next best one on them. some: words that have a label."""
    k = e.shape[1]
    votes = np.bincount(row[some] * k + label[some], minlength=rows * k).reshape(rows, -1)
    won = np.bincount(row[some] * k + label[some], e[some, label[some]], minlength=rows * k).reshape(rows, -1)
    told, most = votes.sum(1), votes.max(1)
    best = np.where(told > 0, np.where(votes == most[:, None], won, -np.inf).argmax(1), -1)
    of = some & (label == best[row])
    total = np.zeros((rows, k))
    for c in range(k):
        total[:, c] = np.bincount(row[of], e[of, c], minlength=rows)
    at = np.arange(rows), np.maximum(best, 0)
    own = total[at]
    total[at] = -np.inf
    lead = own - total.max(1) if k > 1 else np.full(rows, np.inf)
    return best, np.where(told > 0, most / np.maximum(1, told) / (1 + np.exp(-np.clip(lead, -50, 50))), 0.0)


def predict_batch(column: pa.Array, model: Model, switch: float) -> tuple[list, list, pa.Array]:
    """Languages, scores and spans of texts."""
    names = model.languages
    langs, scores = [UNDETERMINED] * len(column), [0.0] * len(column)
    span_n, s_lang, s_first, s_size = np.zeros(len(column), np.int64), [], [], []
    for i, j in tokens.slices(column, SLICE // max(8, len(names))) if names else ():
        buf, off = tokens.buffer(column.slice(i, j - i))
        w = tokens.split(buf, off)
        if not len(w.start):
            continue
        e = _scores(buf, w, model)
        script = _scripts(buf, w)
        may = model.allowed[script] & (script >= 0)[:, None]
        some = may.any(1)
        e = np.where(may, e, np.float32(-1e3)) * some[:, None]
        label = decode(e, w.ptr, switch)
        size = np.diff(w.ptr)
        row = np.repeat(np.arange(j - i), size)
        lettered = np.bincount(row[script >= 0], minlength=j - i)
        change = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (row[1:] != row[:-1])]))
        ends = np.append(change[1:], len(label))
        keep = np.add.reduceat(some.astype(np.int64), change) > 0
        change, ends = change[keep], ends[keep]
        span_n[i:j] = np.bincount(row[change], minlength=j - i)
        s_lang.append(label[change])
        s_first.append(change - w.ptr[:-1][row[change]])
        s_size.append(ends - change)
        best, sure = _judge(e, label, row, some, j - i)
        for r in np.flatnonzero(lettered > 0):
            langs[i + r], scores[i + r] = names[best[r] if best[r] >= 0 else model.commonest], float(sure[r])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    lang = pa.array(np.array(names, object)[cat(s_lang)] if names else [], pa.string())
    spans = pa.StructArray.from_arrays([lang, pa.array(cat(s_first), pa.int32()), pa.array(cat(s_size), pa.int32())], ["lang", "first_word", "n_words"])
    return langs, scores, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(span_n)]), pa.int32()), spans)


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, lang_pred: str = "lang_pred", score: str = "score", spans: str = "spans") -> DataFrame:
    """Adds to the documents their language, how sure it is (0 to 1), and the labelled spans in words."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = list(docs.columns)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            got, sure, found = predict_batch(batch.column(at), held.value, switch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string()), pa.array(sure, pa.float64()), found], [*names, lang_pred, score, spans])

    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(spans, span)])
    return docs.mapInArrow(lean(label), schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo a number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def accuracy(pred: pd.DataFrame) -> float:
    """Share of held-out rows whose lang_pred is their lang."""
    held = pred[pred["held_out"]]
    return float((held["lang"] == held["lang_pred"]).mean())
