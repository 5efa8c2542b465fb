"""Removes lines that are boilerplate across sites.

A line counts as boilerplate if it stands on at least `min_sites` distinct sites and in as many distinct bodies of text.
Equal texts are one body, so that a document copied to many sites is not taken for boilerplate; where more is known,
`body` names a column that is equal in documents that are copies of each other. What stands next to a line does not matter,
so every line of a footer goes.

Spread is measured by HyperLogLog sketches per line hash, which are merged by aggregation. Lines whose estimates are too
near a threshold for the sketch's error get exact distinct counts. Lines seen on one site or in one body only are left out
before any sketch is built. Only DataFrame functions are used.

Defined cases: a null text stays null and an empty one empty; lines without a word are never removed; the null source is
a site of its own; repeated rows count as further occurrences on the same site; a line exactly at the threshold goes; a
very long text is one row like others, its lines an array of hashes; an empty table gives an empty result; other columns
are kept whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, own_names, small, stored, words
from .components import components

MIN_SITES = 5
LG_K = 12
#: Relative distance from the threshold within which the sketch does not decide; five standard errors of a sketch of 2^12.
BAND = 0.08
#: So many boilerplate lines are matched inside the scan; more are matched by a join.
INLINE = 2000
#: Words of a shingle, and how many least hashes of a text say of whom it may be a copy.
SHINGLE, VALUES = 5, 8
#: The share of shingles that copies have in common, or have if lines of their own are edited ones of the other, of which
#: such a share is left; and how many least hashes decide on it, of the whole text and of lines of its own.
SAME, HALF, WITHIN, SKETCH, REST = 0.8, 0.5, 0.15, 256, 64
#: Texts that one is held against.
HELD = 6
SPACES = " \t\n\x0b\x0c\r"


def _hashes(text: Column) -> Column:
    """Per line its hash; null for lines without a word."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.btrim(x, F.lit(SPACES)) != "", F.xxhash64(x)))


def lines(docs: DataFrame, site: str, body: str | None = None) -> DataFrame:
    """h, site, body of every line with a word."""
    own = F.xxhash64(F.col(f"`{body or 'text'}`"))
    base = docs.filter(F.col("text").isNotNull()).select(F.xxhash64(F.col(f"`{site}`")).alias("site"), own.alias("body"), _hashes(F.col("text")).alias("hs"))
    return base.select("site", "body", F.explode("hs").alias("h")).filter("h IS NOT NULL")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, body: str | None = None) -> DataFrame:
    """h of the boilerplate lines, with the sites and bodies counted and whether they were counted exactly."""
    every = lines(docs, site, body)
    several = every.groupBy("h").agg(F.count("*").alias("n"), *(f(x).alias(f"{x}{i}") for x in ("site", "body") for i, f in enumerate((F.min, F.max))))
    several = stored(several.filter((F.col("n") >= min_sites) & (F.col("site0") != F.col("site1")) & (F.col("body0") != F.col("body1"))).select("h"), "lines-several")
    sketched = every.join(small(several), "h").groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"), F.hll_sketch_agg("body", F.lit(LG_K)).alias("b"))
    seen = stored(sketched.select("h", F.hll_sketch_estimate("s").alias("sites"), F.hll_sketch_estimate("b").alias("bodies")), "lines-spread")
    least = F.least("sites", "bodies")
    above, below = least > min_sites * (1 + BAND), least < min_sites * (1 - BAND)
    near = every.join(small(seen.filter(~above & ~below).select("h")), "h")
    exact = near.groupBy("h").agg(F.count_distinct("site").alias("sites"), F.count_distinct("body").alias("bodies")).filter(least >= min_sites)
    cols = ["h", F.col("sites").cast("long").alias("sites"), F.col("bodies").cast("long").alias("bodies")]
    return seen.filter(above).select(*cols, F.lit(False).alias("exact")).unionByName(exact.select(*cols, F.lit(True).alias("exact")))


def _shingles(text: Column, size: int) -> Column:
    """The distinct hashes of a text's shingles, sorted; a text with fewer words is one, one without words has none."""
    hs = F.transform(words(text), lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    made = lambda h: F.when(F.size(h) >= size, windows(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(F.array_distinct(F.element_at(F.transform(F.array(hs), made), 1)))


def bodies(docs: DataFrame, name: str = "body", site: str = "source", size: int = SHINGLE, values: int = VALUES, same: float = SAME, half: float = HALF, within: float = WITHIN) -> DataFrame:
    """Adds a column that is equal in documents that are copies of each other, though not to the letter.

    Copies share `same` of all their shingles of `size` words, or `half` if what one of them has beside the lines that stand
    on many sites is in the other too, by a share of `within` at least: lines of copies are edited, and keep some of their
    shingles, but those of other pages with the same footer are others. Who may be a copy of whom is told by a few least
    hashes of the whole text, and of what is left of it without those lines: every hash is owned by the first of the texts
    of about a length that have it, and a text is held against those that own most of its hashes. That is decided by
    their shingles: by all of them up to `SKETCH`, which pages with little text of their own have, else by the `SKETCH`
    least, which tell the share to about 0.03. Copies of copies are one body."""
    text = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("own"), F.col("text").alias("whole"), "text", F.col(f"`{site}`").alias("site"))
    found = stored(boilerplate(text, "site").select("h"), "lines-spread-texts")
    cut = _without(text, found)
    whole = _shingles(F.col("whole"), size)
    part = F.when(F.col("text") != F.col("whole"), F.slice(_shingles(F.col("text"), size), 1, REST))
    # texts that share so much differ in their number of shingles by one step at most
    step = F.floor(F.log(F.greatest(F.size("sk"), F.lit(1))) / F.lit(-math.log(half))).cast("int")
    both = cut.select("own", whole.alias("sk"), part.alias("rest")).select("own", "rest", step.alias("step"), F.slice("sk", 1, SKETCH).alias("sk"))
    both = stored(both, "lines-sketches")
    least = F.array_union(F.slice("sk", 1, values), F.slice(F.coalesce("rest", F.array().cast("array<bigint>")), 1, values))
    each = both.select("own", "step", F.explode(least).alias("v")).distinct()
    per = each.groupBy("v", "step").agg(F.count("*").alias("m"), F.min("own").alias("of"))
    owners = per.groupBy("v").agg(F.sum("m").alias("m"), F.collect_list(F.struct("step", "of")).alias("owners")).filter("m > 1")
    owners = stored(owners.select("v", "owners"), "lines-owners")
    fit = F.filter("owners", lambda o: (F.abs(o["step"] - F.col("step")) <= 1) & (o["of"] != F.col("own")))
    owned = each.join(small(owners), "v").select("own", F.explode(fit).alias("o")).groupBy("own", "o.of").agg(F.count("*").alias("n"))
    first = F.slice(F.sort_array(F.collect_list(F.struct("n", "of")), False), 1, HELD)
    pairs = stored(owned.groupBy("own").agg(first.alias("first")).select("own", F.explode("first.of").alias("of")), "lines-pairs")
    sketch = both.groupBy("own").agg(F.first("sk").alias("sk"), F.first(F.coalesce("rest", F.slice("sk", 1, REST))).alias("rest"))
    union = F.slice(F.sort_array(F.array_union("a", "b")), 1, SKETCH)
    share = F.size(F.array_intersect(F.array_intersect(union, "a"), "b")) / F.size(union)
    # of a long text only the least shingles are known, so only such of the rest are looked for in it
    seen = F.when(F.size("b") < SKETCH, F.col("rest")).otherwise(F.filter("rest", lambda x: x <= F.element_at("b", -1)))
    edited = F.size(F.array_intersect(seen, "b")) >= within * F.size(seen)
    held = pairs.join(sketch.toDF("own", "a", "rest"), "own").join(sketch.select("own", "sk").toDF("of", "b"), "of")
    held = held.filter((share >= same) | ((share >= half) & (F.size(seen) > 0) & edited) | ((share >= half) & (F.size("rest") == 0)))
    root = components(held.select(F.col("own").alias("a"), F.col("of").alias("b")))
    discard(found, both, owners, pairs)
    at = own_names(docs, "copy", "of")
    told = docs.join(small(root.toDF(at["copy"], at["of"])), F.xxhash64("text") == F.col(at["copy"]), "left")
    return told.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(F.col(at["of"]), F.xxhash64("text")).alias(name))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, n_lines: str | None = None, n_removed: str | None = None, body: str | None = None) -> DataFrame:
    """The documents, with boilerplate lines taken out of `text`. Names in n_lines and n_removed add columns: the lines
    with a word that a document had, and how many of them went."""
    found = stored(boilerplate(docs, site, min_sites, body).select("h"), "lines-boilerplate")
    return _without(docs, found, n_lines, n_removed)


def _without(docs: DataFrame, found: DataFrame, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """The documents without the lines of found (h)."""
    name = own_names(docs, "hs", "at", "key", "pos", "hit", "cut")
    hs, at = F.col(name["hs"]), F.col(name["at"])
    out = docs.withColumn(name["hs"], F.coalesce(_hashes(F.col("text")), F.array().cast("array<bigint>")))
    known = [r["h"] for r in found.limit(INLINE + 1).collect()]
    if len(known) <= INLINE:
        out = out.withColumn(name["at"], F.filter(F.transform(hs, lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull()) if known else F.array().cast("array<int>"))
    else:
        key = F.xxhash64("text")
        each = docs.select(key.alias(name["key"]), F.posexplode(_hashes(F.col("text"))).alias(name["pos"], "h"))
        hits = each.join(small(found), "h").groupBy(name["key"]).agg(F.sort_array(F.collect_set(name["pos"])).alias(name["hit"]))
        out = out.withColumn(name["key"], key).join(hits, name["key"], "left").withColumn(name["at"], F.coalesce(name["hit"], F.array().cast("array<int>")))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(hs) - 1), at), lambda i: F.col(name["cut"])[i])
    kept = F.array_join(rest, "\n")
    out = out.withColumn(name["cut"], F.when(F.size(at) > 0, F.split("text", "\n")))
    text = F.when(F.size(at) == 0, F.col("text")).otherwise(kept)
    extra = []
    if n_lines:
        extra.append(F.size(F.filter(hs, lambda h: h.isNotNull())).cast("long").alias(n_lines))
    if n_removed:
        extra.append(F.size(at).cast("long").alias(n_removed))
    return out.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), *extra)
