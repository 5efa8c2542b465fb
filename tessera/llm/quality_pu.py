"""Quality classifier learned from positive and unlabelled texts.

Trusted positives and unlabelled web text give a linear model over surface features and hashed words by minimising the
non-negative unbiased risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  with logistic loss, so that its score
estimates the chance that a text is good. The class prior is estimated too: with a first model of positive against
unlabelled, the ratio of the two groups' shares above a threshold is smallest where only positives are left, and that
ratio is the prior.

Features of all texts are computed once and stored. Of the labelled positives, at most about `train_rows` are learned
from, chosen by a hash of the document; the risk on unlabelled texts is over all of them: each step of the descent is a
sum over the stored features, in Spark, of which the driver gets as many numbers as there are weights.

Defined cases: null and empty texts are scored by their (zero) features; a very long text has features like others, which
are shares of its words and characters; null labels are no labels; a document with several labels counts as positive if
all are 1; without positives or unlabelled rows every score is 0.5; repeated rows are scored alike, as are different
texts of equal features; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import stored
from .lean import lean, small_batches

TRAIN_ROWS = 20_000
FEATURES = ["symbols", "bars", "bangs", "capitals", "digits", "commas_stops", "stutter", "distinct", "repeated", "long_words", "short_words", "lines", "log_words", "non_ascii"]

#: Buckets of hashed words.
WORDS = 128
#: Weight decay of features and of hashed words.
DECAY, WORDS_DECAY = 2e-3, 2e-2


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_CLASSES = [_class("#*$%&<>"), _class("|"), _class("!?"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(",."), _class("\n")]
_CLASSES.append((np.arange(256) >= 0xC0).astype(np.uint8))


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES per text, each in about 0 to 1."""
    w, texts = tokens.split(buf, off), len(off) - 1
    n = np.diff(w.ptr)
    count = []
    for c in _CLASSES:
        sums = np.concatenate([[0], np.cumsum(c[buf], dtype=np.int64)])
        count.append(np.diff(sums[off]))
    symbols, bars, bangs, capitals, digits, stops, breaks, other = count
    size = w.end - w.start
    row = np.repeat(np.arange(texts), n)
    chars = np.bincount(row, size, texts)
    h = tokens.hashes(buf, w)
    with np.errstate(over="ignore"):
        own = tokens.mix(row.astype(np.uint64) + np.uint64(1))
        distinct = np.bincount(row[np.unique(h ^ own, return_index=True)[1]], minlength=texts)
        stutter = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=texts)
        win = tokens.windows(h, 5)
        inside = row[4:] == row[: len(row) - 4] if len(win) else np.zeros(0, bool)
        _, back, times = np.unique((win ^ own[: len(win)])[inside], return_inverse=True, return_counts=True)
    repeated = np.bincount(row[: len(win)][inside][times[back] > 1], minlength=texts)
    one, ch = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack(
        [
            np.minimum(symbols / one, 1), np.minimum(3 * bars / one, 1), np.minimum(bangs / one, 1), np.minimum(2 * capitals / ch, 1),
            np.minimum(digits / ch, 1), np.minimum(stops / one, 1), np.minimum(3 * stutter / one, 1), np.where(n, distinct / one, 1),
            np.minimum(repeated / one, 1), np.bincount(row, size > 20, texts) / one, np.bincount(row, size < 3, texts) / one,
            np.minimum(breaks / one, 1), np.minimum(np.log1p(n) / 10, 1), np.minimum(4 * other / ch, 1),
        ],
        1,
    )


def hashed_words(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of WORDS numbers of 0 to 255 per text: roots of the shares of its words that fall in each bucket."""
    w, texts = tokens.split(buf, off), len(off) - 1
    n = np.diff(w.ptr)
    bucket = (tokens.hashes(tokens.fold(buf), w) % np.uint64(WORDS)).astype(np.int64)
    times = np.bincount(np.repeat(np.arange(texts), n) * WORDS + bucket, minlength=texts * WORDS).reshape(texts, WORDS)
    return np.rint(255 * np.sqrt(times / np.maximum(1, n)[:, None])).astype(np.uint8)


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id, its features, and its hashed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in tokens.slices(batch.column("text")):
                texts = tokens.buffer(batch.column("text").slice(i, j - i))
                x = features(*texts).astype(np.float32)
                words = pa.array([r.tobytes() for r in hashed_words(*texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, x.T), words], ["doc_id", *FEATURES, "words"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), ", ".join([f"doc_id {kind}", *(f"{f} float" for f in FEATURES), "words binary"]))


def matrix(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Features and hashed words of rows of `featurise`, in about 0 to 1."""
    if not len(rows):
        return np.zeros((0, len(FEATURES) + WORDS))
    words = np.frombuffer(b"".join(rows.column("words").to_pylist()), np.uint8).reshape(len(rows), WORDS)
    return np.hstack([np.stack([rows.column(f).to_numpy() for f in FEATURES], 1).astype(np.float64), words / 255])


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    prior: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def minimise(f, d: int, rounds: int = 40, near: float = 1e-5) -> np.ndarray:
    """L-BFGS from zero with backtracking; f(w) gives value and gradient."""
    w, pairs = np.zeros(d), []
    value, g = f(w)
    for _ in range(rounds):
        q, back = g.copy(), []
        for s, y in reversed(pairs):
            back.append(s @ q / (s @ y))
            q -= back[-1] * y
        q *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1e-12, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            q += s * (a - y @ q / (s @ y))
        step = 1.0
        while True:
            to, gt = f(w - step * q)
            if to <= value - 1e-4 * step * (g @ q) or step < 1e-3:
                break
            step /= 4
        if to >= value:
            break
        s, y = -step * q, gt - g
        if s @ y > 1e-12:
            pairs = [*pairs[-7:], (s, y)]
        w, done, value, g = w + s, value - to < near * abs(value), to, gt
        if done:
            break
    return w


class Unlabelled(Protocol):
    """All unlabelled rows."""

    n: int

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and standard deviations."""

    def negative_risk(self, scale: Scale, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of taking them as negative, and its gradient."""

    def shares(self, scale: Scale, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Which share has a score of each cut or more."""


class Scale(NamedTuple):
    mean: np.ndarray
    sd: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.sd, -8, 8), np.ones((len(x), 1))])


class Held:
    """Rows in memory."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        return self.x.mean(0), self.x.std(0)

    def negative_risk(self, scale: Scale, w: np.ndarray) -> tuple[float, np.ndarray]:
        x = scale(self.x)
        z = x @ w
        return float(np.logaddexp(0, z).mean()), x.T @ _sigmoid(z) / self.n

    def shares(self, scale: Scale, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return 1 - np.searchsorted(np.sort(scale(self.x) @ w), cuts, "left") / self.n


class Spread:
    """Rows of a table of features. Every figure is a sum of what tasks find over their rows."""

    def __init__(self, feats: DataFrame):
        self.feats = feats.select(*FEATURES, "words")
        self.n = feats.count()

    def _sums(self, f) -> np.ndarray:
        """Sums over all rows of f(matrix), an array."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for i in range(0, len(batch), 10_000):
                    got = f(matrix(batch.slice(i, 10_000)))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.astype(np.float64))], ["i", "v"])

        rows = self.feats.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        x = self._sums(lambda x: np.concatenate([x.sum(0), (x * x).sum(0)])) / self.n
        mean, square = np.split(x, 2)
        return mean, np.sqrt(np.maximum(0, square - mean * mean))

    def negative_risk(self, scale: Scale, w: np.ndarray) -> tuple[float, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            x = scale(x)
            z = x @ w
            return np.append(x.T @ _sigmoid(z), np.logaddexp(0, z).sum())

        x = self._sums(of) / self.n
        return float(x[-1]), x[:-1]

    def shares(self, scale: Scale, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return self._sums(lambda x: len(x) - np.searchsorted(np.sort(scale(x) @ w), cuts, "left")) / self.n


def estimate_prior(p: np.ndarray, u: Unlabelled, scale: Scale, w: np.ndarray) -> float:
    """Share of positives among unlabelled rows, by a model w of positive against unlabelled; p: scores of positives."""
    cuts = np.unique(np.quantile(p, np.linspace(0.01, 0.95, 95)))
    share_p = 1 - np.searchsorted(np.sort(p), cuts, "left") / len(p)
    share_u = u.shares(scale, w, cuts)
    slack = np.sqrt(np.log(20) / 2 / u.n) + np.sqrt(np.log(20) / 2 / len(p))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def risk(w: np.ndarray, xp: np.ndarray, u: Unlabelled, scale: Scale, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk and its gradient. Where the estimated risk on negatives is below zero, it is none."""
    z = xp @ w
    positive, of_positive = np.logaddexp(0, -z).mean(), -xp.T @ _sigmoid(-z) / len(xp)
    value, gradient = u.negative_risk(scale, w)
    negative = value - prior * np.logaddexp(0, z).mean()
    of_negative = gradient - prior * xp.T @ _sigmoid(z) / len(xp)
    return prior * positive + max(0.0, negative), prior * of_positive + (of_negative if negative > 0 else 0)


def fit(p: np.ndarray, u: Unlabelled | np.ndarray, prior: float | None = None) -> Model:
    """From features of positive and of unlabelled rows."""
    u, d = Held(u) if isinstance(u, np.ndarray) else u, p.shape[1]
    if not len(p) or not u.n:
        return Model(np.zeros(d), 0.0, 0.5)
    mean, sd = u.moments()
    scale = Scale(mean, np.maximum(sd, 0.1))
    xp = scale(p)
    decay = np.concatenate([np.full(min(d, len(FEATURES)), DECAY), np.full(max(0, d - len(FEATURES)), WORDS_DECAY), [0]])

    def decayed(value: float, g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        return value + (decay * w * w).sum() / 2, g + decay * w

    def against(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = xp @ w
        value, g = u.negative_risk(scale, w)
        return decayed(np.logaddexp(0, -z).mean() + value, g - xp.T @ _sigmoid(-z) / len(xp), w)

    if prior is None:
        first = minimise(against, d + 1, 15, 1e-3)
        prior = estimate_prior(xp @ first, u, scale, first)
    w = minimise(lambda w: decayed(*risk(w, xp, u, scale, prior), w), d + 1)
    return Model(w[:-1] / scale.sd, float(w[-1] - (w[:-1] / scale.sd * mean).sum()), prior)


def train(feats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """feats: rows to learn from. labels: doc_id and quality of trusted rows, of which only the positives are used."""
    good = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    positive = feats.join(good, "doc_id", "left_semi")
    total = positive.count()
    if train_rows < total:
        positive = positive.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.lit(int(train_rows / total * 1_000_000)))
    return fit(matrix(positive.select(*FEATURES, "words").toArrow()), Spread(feats))


def score(feats: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """doc_id and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(matrix(batch) @ model.weights + model.bias))], ["doc_id", name])

    return feats.mapInArrow(run, f"doc_id {feats.schema['doc_id'].dataType.simpleString()}, {name} double")


def stored_features(docs: DataFrame) -> DataFrame:
    return stored(featurise(docs), "quality-features")
