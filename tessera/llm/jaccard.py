"""Jaccard join of word n-gram sets, size-aware: light sets by enumerated subsets, heavy sets by inverted lists.

Two sets link when their intersection is at least num/den of their union. That fixes, by the sizes of both, how many
elements they must share. A light set names all its subsets of each size that a partner's size can require; two light
sets link exactly if one of those subsets is in both. For heavy sets that would be too many. Their elements are ordered
from rare to frequent, and a set is entered only into the inverted lists of its rarest elements, as many as it can lack
of a partner, and one: two linked sets meet in the list of their first common element, whose places in both also bound
what they can share. So an element that very many texts have stands in the lists of only those that have little else.
The size from which sets are heavy is chosen by cost from the histogram of sizes; sets just above it do both.

How frequent elements are is counted for all texts in a table of fixed size, `BINS`, by hash; any order that is the same
everywhere is right, and a table that cannot tell rare elements apart still tells the frequent ones. By the same table
the lists of frequent elements are split in parts from the beginning, so that none is one task's.

Short lists give all their pairs. In long ones a hub is paired with all others. Pairs are verified, one per set first;
components form, and what is left is only tried between different components: further pairs, and members of long lists,
in tiles. So no link between different components is lost, and lists that are one component are done. Pairs are tested
by parity sketches, whose differing bits never exceed the number of elements that differ, and then by their whole sets.

Elements are 64-bit hashes and matter within a pair only. Equal sets are one; they are told apart by 128 bits, of which
64 address a set, and the few sets that share an address get others.

Defined cases: texts that are null or have no word have an empty set and link with nothing, not even each other; texts
with fewer words than n are one sequence; a very long text is one set like others, held by one task at a time with at
most one partner; repeated rows and ids are documents like others; a null id never names a component unless all ids in
it are null; sizes at the threshold exactly do link; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import discard, small, stored
from .components import components
from .lean import lean, small_batches

#: Lists of at most so many sets give all pairs.
SHORT = 4
#: Pairs of long lists of common subsets that are made at a time.
PAIRS = 1_000_000
#: Members of a long list that meet in a task, twice.
TILE = 512
#: Sets in a part of a list, about.
LIST = 4096
#: Counters of elements, and how many of them make a row.
BINS, ROW = 1 << 18, 1 << 14
#: Cost of a set's candidates, sketched and verified, in entries of lists.
VERIFY = 16
MAX_LIGHT = 60
#: Bits of a sketch for each element that may differ.
BITS = 12
#: Low bits of a list's key that number its parts, 0 for a list in one part.
PART = 0xFFF
#: Place of an entry that is a pair already.
PAIR = -(1 << 31)
#: Bits of a set's address.
ADDRESS = 64


class Threshold(NamedTuple):
    num: int
    den: int

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def largest(self, s: int) -> int:
        """The largest size that links with s."""
        return s * self.den // self.num

    def partner(self, common: int, s: int) -> int:
        """The largest size that links with s by so many common elements."""
        return self.den * common // self.num + common - s

    def differ(self, a: int, b: int) -> int:
        """In how many elements linked sets of sizes up to a and b can differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def lacks(self, s: int) -> int:
        return s * (self.den - self.num) // self.den

    def needed(self, a, b):
        """How many elements linked sets of these sizes share at least."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def entries(self, s):
        """In how many lists a heavy set of that size is."""
        return s + (-self.num * s // self.den) + 1

    def intervals(self, most: int) -> np.ndarray:
        """First sizes of intervals such that linked sets are in the same or in adjacent ones."""
        out = [1]
        while out[-1] <= most:
            out.append(self.largest(out[-1]) + 1)
        return np.array(out, np.int64)


class Sets(NamedTuple):
    size: np.ndarray  # per text
    items: np.ndarray  # all sets, one after another, each sorted
    f: np.ndarray  # address per text, 0 if empty
    g: np.ndarray  # further 64 bits


Twins = dict[tuple[int, int], int]


def _sums(items: np.ndarray, size: np.ndarray, key: int) -> np.ndarray:
    """A hash of each set."""
    out, has = np.zeros(len(size), np.uint64), np.flatnonzero(size)
    if len(has):
        with np.errstate(over="ignore"):
            first = (np.cumsum(size) - size)[has]
            out[has] = tokens.mix(np.add.reduceat(tokens.mix(items + np.uint64(key)), first) + size[has].astype(np.uint64))
    return out


def sets(column: pa.Array, n: int, twins: Twins | None = None) -> Sets:
    """twins: other addresses for sets that share one."""
    buf, off = tokens.buffer(column)
    buf = tokens.fold(buf)
    w = tokens.split(buf, off)
    h = tokens.hashes(buf, w)
    win = tokens.windows(h, n)
    parts = []
    for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True):
        if b - a >= n:
            parts.append(np.unique(win[a : b - n + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                x = np.uint64(b - a)
                for y in h[a:b]:
                    x = tokens.mix(x * np.uint64(0x9E3779B97F4A7C15) + y + np.uint64(0x51ED2701))
            parts.append(np.array([x], np.uint64))
        else:
            parts.append(np.zeros(0, np.uint64))
    size = np.array([len(x) for x in parts], np.int64)
    items = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    f, g = _sums(items, size, 0xA0761D6478BD642F), _sums(items, size, 0x8BB84B93962EACC9)
    f = np.where(size > 0, np.maximum(f >> np.uint64(64 - ADDRESS), np.uint64(1)), np.uint64(0))
    for (x, y), new in (twins or {}).items():
        f[(f.view(np.int64) == x) & (g.view(np.int64) == y)] = np.int64(new).view(np.uint64)
    return Sets(size, items, f, g)


def sketches(s: Sets, t: Threshold) -> list[bytes]:
    """Per set the parity of its elements in a power of two of bins, about BITS for each element that may differ."""
    most = int(s.size.max()) if len(s.size) else 1
    first = t.intervals(most)
    last = first[1:] - 1
    bits = np.array([1 << max(6, int(BITS * (t.differ(int(u), t.largest(int(u))) + 1) - 1).bit_length()) for u in last])
    own = bits[np.maximum(0, np.searchsorted(first, s.size, "right") - 1)]
    base = np.cumsum(own) - own
    row = np.repeat(np.arange(len(s.size)), s.size)
    with np.errstate(over="ignore"):
        at = (tokens.mix(s.items + np.uint64(0x2545F4914F6CDD1D)) & (own[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[row] + at, minlength=int(own.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[b // 8 : (b + n) // 8] for b, n in zip(base, own, strict=True)]


def apart(a: bytes, b: bytes) -> int:
    """At least so many elements differ: differing bits of two sketches; the longer one is folded first."""
    a, b = sorted((a, b), key=len)
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b) * 8
    while n > len(a) * 8:
        n //= 2
        y = (y >> n) ^ (y & ((1 << n) - 1))
    return (x ^ y).bit_count()


def n_subsets(s: int, t: Threshold) -> int:
    total, c = 1, 1
    for d in range(1, t.lacks(s) + 1):
        c = c * (s - d + 1) // d
        total += c
    return total


def boundary(histogram: dict[int, int], t: Threshold) -> int:
    """The size from which sets are heavy, of the least total cost."""
    light = {s: min(n_subsets(s, t), 10**9) for s in range(1, MAX_LIGHT)}
    heavy = {s: t.entries(s) + VERIFY for s in light}
    best, cost, at = None, sum(histogram.get(s, 0) * heavy[s] for s in light), 1
    for x in range(1, MAX_LIGHT + 1):
        if best is None or cost < best:
            best, at = cost, x
        if x in light:
            cost += histogram.get(x, 0) * (light[x] - heavy[x])
    return at


def subsets(items: np.ndarray, t: Threshold) -> Iterator[tuple[int, np.uint64]]:
    """Size and hash of every subset that lacks as many elements as linked sets can."""
    with np.errstate(over="ignore"):
        x = tokens.mix(items + np.uint64(0x8EBC6AF09C88C6E3))
        level = [(len(x), x.sum())]
        for d in range(t.lacks(len(x)) + 1):
            for _, total in level:
                yield len(x) - d, tokens.mix(np.array([total + np.uint64(len(x) - d)]))[0]
            level = [(i, total - x[i]) for last, total in level for i in range(last)]


def _cat(x: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(x).astype(kind) if x else np.zeros(0, kind)


def entries(s: Sets, t: Threshold, heavy: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sig, at, text: the lists in which sets are. at: the place of the list's element in the set's order, or, for a list
    of those that have a common subset, minus its size. counts: of elements, by bin."""
    sig, at, who = [], [], []
    begin = np.cumsum(s.size) - s.size
    for r in np.flatnonzero((s.size > 0) & (s.size <= t.largest(heavy))):
        # sets above the boundary name subsets for partners below it
        got = list(subsets(s.items[begin[r] : begin[r] + s.size[r]], t))
        sig.append(np.array([x for _, x in got], np.uint64) & ~np.uint64(PART))
        at.append(np.array([-c for c, _ in got], np.int64))
        who.append(np.full(len(got), r))
    big = s.size >= heavy
    if big.any():
        row = np.repeat(np.arange(len(s.size)), s.size)
        of = big[row]
        row, items = row[of], s.items[of]
        times = counts[_bins(items)]
        order = np.lexsort((items, times, row))
        row, items, times = row[order], items[order], times[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        of = place < t.entries(s.size[row])
        row, items, times, place = row[of], items[of], times[of], place[of]
        with np.errstate(over="ignore"):
            x = tokens.mix(items ^ np.uint64(0x6A09E667F3BCC909)) & ~np.uint64(PART)
            # the part of a list that is likely to be long goes by the set's address
            parts = np.minimum(PART, times // LIST)
            part = np.where(parts > 0, 1 + (tokens.mix(s.f[row]) % np.maximum(1, parts).astype(np.uint64)).astype(np.int64), 0)
        sig.append(x | part.astype(np.uint64))
        at.append(place)
        who.append(row)
    return _cat(sig, np.uint64), _cat(at, np.int32), _cat(who, np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _bins(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def _new(f: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sets are the first of their address in this task, and all addresses so far."""
    new = np.zeros(len(f), bool)
    new[np.unique(f, return_index=True)[1]] = True
    new &= ~np.isin(f, seen) & (f != 0)
    return new, np.concatenate([seen, f[new]])


def _describe(n: int, t: Threshold, kind: pa.DataType):
    """Texts to (doc_id, n, f, g, sketch) and, at the end of a task, (at, counts): its counters from bin `at` on."""
    names = ["doc_id", "n", "f", "g", "sketch", "at", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count = np.zeros(0, np.uint64), np.zeros(BINS, np.int64)
        for batch in batches:
            for i, j in tokens.slices(batch.column("text")):
                s = sets(batch.column("text").slice(i, j - i), n)
                new, seen = _new(s.f, seen)
                count += np.bincount(_bins(s.items[np.repeat(new, s.size)]), minlength=BINS)
                ids = batch.column("doc_id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids, pa.array(s.size), _signed(s.f), _signed(s.g), pa.array(sketches(s, t), pa.binary()), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
        at = [a for a in range(0, BINS, ROW) if count[a : a + ROW].any()]
        rows = pa.array([count[a : a + ROW].astype("<i8").tobytes() for a in at], pa.binary())
        none = [pa.nulls(len(at), k) for k in (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), rows], names)

    return lean(run)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, counts) to their sums."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for a, x in zip(batch.column("at").to_pylist(), batch.column("counts"), strict=True):
            y = np.frombuffer(x.as_buffer(), np.int64)
            total[a] = total[a] + y if a in total else y.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["at", "counts"])


def _counts(described: DataFrame) -> np.ndarray:
    """Of all texts' elements, by bin: tasks add up what they read, before and after they deal it out by row."""
    kind = "at int, counts binary"
    rows = described.filter("counts IS NOT NULL").select("at", "counts").mapInArrow(_add_counts, kind)
    out = np.zeros(BINS, np.int64)
    for r in rows.repartition(BINS // ROW, "at").mapInArrow(_add_counts, kind).collect():
        out[r["at"] : r["at"] + ROW] = np.frombuffer(r["counts"], np.int64)
    return out


def _sign(n: int, t: Threshold, heavy: int, counts, twins: Twins, every_link: bool):
    """Texts to the entries (sig, at, n, f) of their sets, each set once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for i, j in tokens.slices(batch.column("text")):
                s = sets(batch.column("text").slice(i, j - i), n, twins)
                new, seen = _new(s.f, seen)
                s = Sets(s.size[new], s.items[np.repeat(new, s.size)], s.f[new], s.g[new])
                sig, at, who = entries(s, t, heavy, counts.value)
                f, size = s.f[who], s.size[who].astype(np.int32)
                if not every_link:
                    sig, at, size, f = _linked_here(t, sig, at, size, f)
                yield pa.RecordBatch.from_arrays([_signed(sig), pa.array(at.astype(np.int32)), pa.array(size), _signed(f)], ["sig", "at", "n", "f"])

    return lean(run)


def _linked_here(t: Threshold, sig: np.ndarray, at: np.ndarray, n: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the lists of common subsets, those members that link with the first become pairs here, so that no more than it and
    those that it does not link with go on: all that link with a later member link with the first."""
    sub = np.flatnonzero(at < 0)
    order = sub[np.lexsort((f[sub], n[sub], at[sub], sig[sub]))]
    start, size = _runs(sig[order], at[order])
    head = np.repeat(order[start], size) if len(order) else order
    rest = order != head
    pair = order[rest]
    hub = head[rest]
    ok = t.linked(-at[pair].astype(np.int64), n[hub].astype(np.int64), n[pair].astype(np.int64)) & (f[hub] != f[pair])
    pair, hub = pair[ok], hub[ok]
    stay = np.ones(len(sig), bool)
    stay[pair] = False
    # an entry that is a pair is addressed by one of its sets and holds the other
    return tuple(np.concatenate(x) for x in ((sig[stay], f[pair]), (at[stay], np.full(len(pair), PAIR)), (n[stay], n[pair]), (f[stay], f[hub])))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(change)
    return start, np.diff(np.append(start, len(change)))


def _pairs_of(start: np.ndarray, m: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All pairs of lists of m members."""
    both = [(start + i, start + j) for i in range(m) for j in range(i + 1, m)]
    return [a for a, _ in both], [b for _, b in both]


def _may(t: Threshold, n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether members a and b of a list can link by their sizes and the places of the list's element."""
    na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
    return (t.den * np.minimum(na, nb) >= t.num * np.maximum(na, nb)) & (np.minimum(na - at[a], nb - at[b]) >= t.needed(na, nb))


def _partnered(t: Threshold, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which members of a list can link with some other by size and place."""
    kinds, kind, times = np.unique(np.stack([n.astype(np.int64), at.astype(np.int64)]), axis=1, return_inverse=True, return_counts=True)
    if kinds.shape[1] > 512:
        return np.ones(len(n), bool)
    i, j = np.indices((kinds.shape[1],) * 2)
    may = _may(t, kinds[0], kinds[1], i.ravel(), j.ravel()).reshape(i.shape)
    may &= (i != j) | (times > 1)
    return may.any(1)[kind.ravel()]


def _hub(at: np.ndarray, f: np.ndarray) -> int:
    """The member of a list with the fewest rarer elements: of copies, the one with the fewest changes of its own."""
    return int(np.lexsort((f, at))[0])


def _scan(t: Threshold, every_link: bool):
    """Entries (sig, at, n, f) in order, equal sigs together, to rows (kind, list, a, b, n, at): kind 0 is a pair with a
    large common subset, 1 a pair with a common element, 2 a member a of a long list, 3 a hub a of a part of a list."""

    def lists(sig, at, n, f) -> Iterator[pa.RecordBatch]:
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (f[1:] != f[:-1]) | (at[1:] != at[:-1])
        sig, at, n, f = sig[keep], at[keep], n[keep], f[keep]
        start, size = _runs(sig, np.minimum(at, 0))

        def pairs(kind: int, a_: list, b_: list) -> pa.RecordBatch:
            a, b = _cat(a_, np.int64), _cat(b_, np.int64)
            ok = f[a] != f[b]
            ok &= t.linked(-at[a].astype(np.int64), n[a].astype(np.int64), n[b].astype(np.int64)) if kind == 0 else _may(t, n, at, a, b)
            return rows(kind, f[a[ok]], f[b[ok]])

        def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first, _ = _runs(a, b)
            return out(kind, np.zeros(len(first), np.int64), a[first], b[first], np.zeros(len(first)), np.zeros(len(first)))

        def out(kind, key, a, b, size, place) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (key, a, b)), *(pa.array(x.astype(np.int32)) for x in (size, place))], ["kind", "list", "a", "b", "n", "at"])

        done = at == PAIR
        if done.any():
            yield rows(0, sig[done], f[done])
        common = (at[start] < 0) & (at[start] != PAIR)
        a_, b_, held = [], [], 0
        for st, m in zip(start[common & (size > 1)], size[common & (size > 1)], strict=True):
            # members link up to a largest size, which falls from one to the next, so that all that link at all link
            # with the first
            own = n[st : st + m]
            for k in range(m - 1):
                end = int(np.searchsorted(own, t.partner(-int(at[st]), int(own[k])), "right"))
                if end <= k + 1:
                    break
                a_.append(np.full(end - k - 1, st + k))
                b_.append(np.arange(st + k + 1, st + end))
                held += end - k - 1
                if held >= PAIRS:
                    yield pairs(0, a_, b_)
                    a_, b_, held = [], [], 0
                if not every_link:
                    break
        if a_:
            yield pairs(0, a_, b_)
        a_, b_ = [], []
        whole = (sig[start] & PART) == 0
        for m in range(2, SHORT + 1):
            a, b = _pairs_of(start[(at[start] >= 0) & whole & (size == m)], m)
            a_ += a
            b_ += b
        known: set[tuple[int, int, int]] = set()
        split: list[int] = []
        members: list[tuple[np.ndarray, ...]] = []
        long = (at[start] >= 0) & (~whole | (size > SHORT))
        for st, m in zip(start[long], size[long], strict=True):
            own = np.arange(st, st + m)
            if sig[st] & PART:  # the other parts are elsewhere
                key, place = sig[st] & ~PART, at[own]
                split.append(st + _hub(at[own], f[own]))
            else:
                own = own[_partnered(t, n[own], at[own])]
                if len(own) < 2:
                    continue
                with np.errstate(over="ignore"):
                    x, y = (int(tokens.mix(f[own].view(np.uint64) ^ np.uint64(k)).sum()) for k in (1, 2))
                if (x, y, len(own)) in known:  # lists of the same sets, as copies have many, are one
                    continue
                known.add((x, y, len(own)))
                key, place = np.uint64(x).view(np.int64), np.zeros(len(own), np.int32)
            hub = int(own[_hub(at[own], f[own])])
            a_.append(np.full(len(own), hub))
            b_.append(own)
            members.append((np.full(len(own), key), f[own], n[own], place))
        yield pairs(1, a_, b_)
        if members:
            key, a, size_, place = (np.concatenate(x) for x in zip(*members, strict=True))
            yield out(2, key, a, a, size_, place)
        if split:
            at_ = np.array(split)
            yield out(3, sig[at_] & ~PART, f[at_], f[at_], n[at_], at[at_])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            rows = tuple(batch.column(x).to_numpy() for x in ("sig", "at", "n", "f"))
            if not len(rows[0]):
                continue
            whole = np.flatnonzero(rows[0] != rows[0][-1])  # the last list may go on
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield from lists(*(np.concatenate(x) for x in zip(*held, tuple(r[:cut] for r in rows), strict=True)))
                held = []
            held.append(tuple(r[cut:].copy() for r in rows))
        if held:
            yield from lists(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return lean(run)


def _near(t: Threshold):
    """Pairs (a, b, na, nb, sa, sb) whose sketches let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            most = (na + nb) * (t.den - t.num) // (t.den + t.num)
            ok = t.den * np.minimum(na, nb) >= t.num * np.maximum(na, nb)
            ok &= np.array([apart(x, y) <= m for x, y, m in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), most, strict=True)], bool)
            out = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], ["a", "b"])

    return lean(run)


def _whole(n: int, twins: Twins):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in tokens.slices(batch.column("text")):
                s = sets(batch.column("text").slice(i, j - i), n, twins)
                end = np.cumsum(s.size)
                yield pa.RecordBatch.from_arrays([_signed(s.f), pa.array([s.items[b - k : b].tobytes() for b, k in zip(end, s.size, strict=True)], pa.binary())], ["f", "items"])

    return lean(run)


def _verify(t: Threshold):
    """Rows (hub, part, f, items) in order, those of a part together and its hub's before all others, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, last = None, np.zeros(0, np.uint64), None
        for batch in batches:
            a, b = [], []
            for hub, part, f, x in zip(batch.column("hub").to_pylist(), batch.column("part").to_pylist(), batch.column("f").to_pylist(), batch.column("items"), strict=True):
                if (hub, part, f) == last:  # a copy
                    continue
                last = hub, part, f
                items = np.frombuffer(x.as_buffer(), np.uint64)
                if f == hub:
                    now, own = (hub, part), items.copy()
                    continue
                if now != (hub, part):
                    raise RuntimeError("a hub's set is missing")
                common = len(items) + len(own) - len(np.union1d(items, own))
                if t.linked(common, len(own), len(items)):
                    a.append(min(hub, f))
                    b.append(max(hub, f))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lean(run)


class Join(NamedTuple):
    described: DataFrame  # doc_id, n, f of every document
    links: DataFrame  # a, b: addresses of linked sets; enough to connect all that are connected, or every link
    roots: DataFrame  # node, root: component of each linked set


def _twins(described: DataFrame) -> Twins:
    """New addresses for different sets that share one; of 10^10 sets, a few do."""
    each = described.filter("n > 0").groupBy("f", "g").agg(F.lit(1).alias("one"))
    several = each.groupBy("f").agg(F.count("*").alias("m")).filter("m > 1").select("f")
    rows = each.join(F.broadcast(several), "f").select("f", "g", F.xxhash64("f", "g").alias("new")).collect()
    return {(r["f"], r["g"]): r["new"] for r in rows}


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, every_link: bool = False) -> Join:
    """Links the documents (doc_id, text) by their sets of n consecutive words. every_link: also the links inside of
    components that are connected without them, of which a large group of near copies has very many."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    t = Threshold(num, den)
    base = docs.select("doc_id", "text")
    id_kind = docs.schema["doc_id"].dataType
    raw = stored(base.mapInArrow(_describe(n, t, to_arrow_type(id_kind)), f"doc_id {id_kind.simpleString()}, n long, f long, g long, sketch binary, at int, counts binary"), "jaccard-sets")
    counts, twins = spark.sparkContext.broadcast(_counts(raw)), _twins(raw)
    address = F.col("f")
    for (x, y), new in twins.items():
        address = F.when((F.col("f") == x) & (F.col("g") == y), F.lit(new)).otherwise(address)
    described = raw.filter("n IS NOT NULL").select("doc_id", "n", address.alias("f"), "sketch")
    known = stored(described.filter("n > 0").groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "jaccard-distinct")
    histogram = {r["n"]: r["count"] for r in known.filter(F.col("n") < MAX_LIGHT).groupBy("n").count().collect()}
    heavy = boundary(histogram, t)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = base.mapInArrow(_sign(n, t, heavy, counts, twins, every_link), "sig long, at int, n int, f long").repartition(parts, "sig").sortWithinPartitions("sig", "at", "n", "f")
    scanned = stored(signed.mapInArrow(_scan(t, every_link), "kind int, list long, a long, b long, n int, at int"), "jaccard-lists")
    pairs = scanned.filter("kind < 2").select("a", "b")
    hubs = scanned.filter("kind = 3").select("list", F.col("a").alias("f"))
    least = hubs.groupBy("list").agg(F.min("f").alias("a"))
    pairs = pairs.unionByName(hubs.join(least, "list").filter("f <> a").select("a", F.col("f").alias("b")))
    pairs = stored(pairs.distinct(), "jaccard-pairs")
    verified = lambda some: _links(base, known, some, n, t, twins)
    if every_link:
        links = verified(pairs)
    else:
        # one pair of each set first, where that is much less; it mostly is enough
        first = stored(_likeliest(pairs), "jaccard-first")
        every = pairs.count() <= 2 * first.count()
        links = verified(pairs if every else first)
        if not every:
            left = stored(_between(pairs.join(first, ["a", "b"], "left_anti"), components(links)), "jaccard-left")
            more = verified(left)
            links = links if more.isEmpty() else stored(links.unionByName(more), "jaccard-links")
            discard(left)
        discard(first)
    discard(pairs)
    roots = components(links)
    long = scanned.filter("kind = 2").select("list", F.col("a").alias("f"), "n", "at")
    if not long.isEmpty():
        # the likeliest partners of each set first, then whatever is still in different components
        for few in (0,) if every_link else (2, 0):
            apart_ = roots.filter(F.lit(False)) if every_link else roots  # each set on its own
            crossed = _cross(long, apart_, known, t, few)
            if crossed is None:
                break
            more = verified(crossed)
            if not more.isEmpty():
                links = stored(links.unionByName(more).distinct(), "jaccard-links")
                roots = components(links)
            discard(crossed)
    discard(scanned, known)
    return Join(described.select("doc_id", "n", "f"), links, roots)


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of each set the pair with the partner that has the most pairs: a hub, of which a list of copies has one."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    many = both.groupBy("a").agg(F.count("*").alias("m"))
    best = both.join(many, "a").groupBy("b").agg(F.max(F.struct("m", "a")).alias("x"))
    return best.select(F.least("x.a", "b").alias("a"), F.greatest("x.a", "b").alias("b")).distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are in different components."""
    ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    both = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _tiles(t: Threshold, few: int):
    """Rows (list, i, j, guest, f, n, at, root, sketch) with equal tiles together to the pairs of a guest and another of a
    different component that can link by their sizes, places and sketches. few: at most so many of each guest, with the
    least differing sketches; 0 for all."""

    def tile(guest: np.ndarray, n: np.ndarray, at: np.ndarray, f: np.ndarray, root: np.ndarray, minor: np.ndarray, sketch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        short = min(map(len, sketch))
        bits = []
        for x in sketch:
            y = np.frombuffer(x, np.uint8)
            while len(y) > short:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            bits.append(y)
        bits = np.stack(bits).view(np.uint64)
        guests, own = np.flatnonzero(guest), np.flatnonzero(~guest)
        a_, b_ = [], []
        for g in np.array_split(guests, max(1, -(-len(guests) * max(1, len(own)) // 500_000))):
            # two guests meet in two tiles
            may = (root[g, None] != root[None, own]) & (~minor[None, own] | (f[g, None] < f[None, own]))
            a, b = np.nonzero(may)
            a, b = g[a], own[b]
            ok = _may(t, n, at, a, b)
            a, b = a[ok], b[ok]
            differ = np.empty(len(a), np.int64)
            for c in range(0, len(a), 100_000):
                differ[c : c + 100_000] = np.bitwise_count(bits[a[c : c + 100_000]] ^ bits[b[c : c + 100_000]]).sum(1, dtype=np.int64)
            ok = differ <= (n[a] + n[b]) * (t.den - t.num) // (t.den + t.num)
            a, b, differ = a[ok], b[ok], differ[ok]
            if few:
                order = np.lexsort((differ, a))
                a, b = a[order], b[order]
                ok = np.arange(len(a)) - np.searchsorted(a, a) < few
                a, b = a[ok], b[ok]
            a_.append(a)
            b_.append(b)
        return _cat(a_, np.int64), _cat(b_, np.int64)

    def tiles(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        key, i, j, f, n, at, root = (rows.column(c).to_numpy() for c in ("list", "i", "j", "f", "n", "at", "root"))
        guest, minor = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("guest", "minor"))
        n, sketch = n.astype(np.int64), rows.column("sketch").to_pylist()
        a_, b_ = [], []
        for st, m in zip(*_runs(key, i, j), strict=True):
            x = slice(st, st + m)
            a, b = tile(guest[x], n[x], at[x], f[x], root[x], minor[x], sketch[x])
            a_.append(a + st)
            b_.append(b + st)
        a, b = f[_cat(a_, np.int64)], f[_cat(b_, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = [batch.column(c).to_numpy() for c in ("list", "i", "j")]
            whole = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield tiles(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
            if held and len(held) > 1 and any(held[0].column(c)[0] != batch.column(c)[0] for c in ("list", "i", "j")):
                yield tiles(pa.Table.from_batches(held[:-1]))
                held = held[-1:]
        if held:
            yield tiles(pa.Table.from_batches(held))

    return lean(run)


def _cross(long: DataFrame, roots: DataFrame, known: DataFrame, t: Threshold, few: int) -> DataFrame | None:
    """Candidates (a, b), if any, among the members of each long list that are in different components.

    Lists that are one component by now are done. Of the others, those that are mostly of one component are put together,
    as a group of copies makes many with nearly the same members. All members outside of a list's largest component are
    guests; guests and members are cut in tiles, so that a task holds one tile of each, and pairs are tested by places and
    sketches where they meet. Of m members and g guests, g / TILE * m + m / TILE * g rows are dealt."""
    member = long.distinct().join(roots, F.col("f") == F.col("node"), "left").select("list", "f", "n", "at", F.coalesce("root", "f").alias("root"))
    member = stored(member, "jaccard-members")
    per = member.groupBy("list", "root").agg(F.count("*").alias("m"))
    main = per.groupBy("list").agg(F.sum("m").alias("m"), F.count("*").alias("roots"), F.max(F.struct("m", "root")).alias("top")).filter("roots > 1")
    main = stored(main.select("list", F.when(2 * F.col("top.m") >= F.col("m"), F.col("top.root")).alias("merged")), "jaccard-several")
    if main.isEmpty():
        return None
    # a list that keeps its own members is told from those put together by its sign of `own`
    joined = member.join(small(main), "list").select(F.coalesce("merged", "list").alias("list"), F.col("merged").isNull().alias("own"), "f", "n", F.when(F.col("merged").isNull(), F.col("at")).otherwise(0).alias("at"), "root").distinct()
    joined = stored(joined.withColumn("list", F.xxhash64("list", "own")).drop("own"), "jaccard-open")
    tops = joined.groupBy("list", "root").agg(F.count("*").alias("m")).groupBy("list").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("top"))
    tops = stored(tops.select("list", F.col("top.root").alias("main"), F.ceil(F.col("m") / TILE).cast("int").alias("ti"), F.ceil((F.col("m") - F.col("top.m")) / TILE).cast("int").alias("tj")).filter("tj > 0"), "jaccard-tops")
    open_ = joined.join(small(tops), "list").withColumn("minor", F.col("root") != F.col("main")).join(known.select("f", "sketch"), "f")
    columns = ("minor", "f", "n", "at", "root", "sketch")
    i, j = (F.pmod(F.xxhash64("f"), F.col(x)).cast("int") for x in ("ti", "tj"))
    own = open_.select("list", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("tj") - 1)).alias("j"), F.lit(False).alias("guest"), *columns)
    guests = open_.filter("minor").select("list", F.explode(F.sequence(F.lit(0), F.col("ti") - 1)).alias("i"), j.alias("j"), F.lit(True).alias("guest"), *columns)
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("list", "i", "j")
    met = own.unionByName(guests).repartition(parts, *keys).sortWithinPartitions(*keys, "f")
    out = stored(met.mapInArrow(_tiles(t, few), "a long, b long").distinct(), "jaccard-cross")
    discard(member, main, joined, tops)
    return None if out.isEmpty() else out


def _links(docs: DataFrame, known: DataFrame, pairs: DataFrame, n: int, t: Threshold, twins: Twins) -> DataFrame:
    """Those of the candidate pairs (a, b) that link, as a table.

    The whole set of b travels once to that of a, its hub; the members of a hub are dealt to parts, with a copy of the
    hub's set in each."""
    sketch = known.select("f", "n", "sketch")
    both = pairs.join(sketch.toDF("a", "na", "sa"), "a").join(sketch.toDF("b", "nb", "sb"), "b")
    near = stored(both.mapInArrow(_near(t), "a long, b long"), "jaccard-near")
    if near.isEmpty():
        return near
    many = near.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count("*") / LIST).alias("parts"))
    dealt = near.join(many, near["a"] == many["hub"]).select(F.col("b").alias("f"), "hub", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    dealt = dealt.unionByName(many.select(F.col("hub").alias("f"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part")))
    dealt = stored(dealt, "jaccard-dealt")
    needed = stored(dealt.select("f").distinct().join(known.select("f", "doc_id"), "f").select("doc_id").distinct().withColumnRenamed("doc_id", "wanted"), "jaccard-needed")
    texts = docs.join(small(needed), docs["doc_id"].eqNullSafe(F.col("wanted"))).select("text")
    whole = texts.mapInArrow(_whole(n, twins), "f long, items binary").join(small(dealt), "f").select("hub", "part", "f", "items")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = whole.repartition(parts, "hub", "part").sortWithinPartitions("hub", "part", F.col("f") != F.col("hub"), "f")
    out = stored(met.mapInArrow(_verify(t), "a long, b long"), "jaccard-links")
    discard(near, dealt, needed)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) of every document."""
    j = join(docs, n, num, den)
    ids = j.described.groupBy("f").agg(F.min("doc_id").alias("least"))
    comp = ids.join(j.roots, ids["f"] == j.roots["node"], "left").select("f", F.coalesce("root", "f").alias("root"), "least")
    smallest = comp.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(comp.join(smallest, "root").select("f", "component_id"), "jaccard-components")
    out = j.described.join(small(of), "f")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def link_counts(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, class_id (smallest doc_id of those with an equal set; null for an empty set) and n_links (other sets that
    link with it) of every document; with `linked_classes`, the whole join without copies written out."""
    j = join(docs, n, num, den, every_link=True)
    ends = j.links.select(F.col("a").alias("f")).unionByName(j.links.select(F.col("b").alias("f")))
    counted = ends.groupBy("f").agg(F.count("*").alias("n_links"))
    ids = j.described.filter("n > 0").groupBy("f").agg(F.min("doc_id").alias("class_id")).join(counted, "f", "left")
    of = stored(ids, "jaccard-classes")
    out = j.described.join(small(of), "f", "left")
    return out.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def linked_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """a, b: every pair of classes of equal sets that link, by their smallest doc_ids."""
    j = join(docs, n, num, den, every_link=True)
    ids = stored(j.described.filter("n > 0").groupBy("f").agg(F.min("doc_id").alias("id")), "jaccard-classes")
    pairs = j.links.join(ids.toDF("a", "ia"), "a").join(ids.toDF("b", "ib"), "b")
    return pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
