"""URL filter of given rules and of rules mined from labels.

Given rules name a host and a path prefix; the longest that fits decides. Urls that none fits are judged by association
rules: FP-growth mines token combinations from the urls of labelled pages, for both verdicts. A combination is kept if it
has enough support and confidence, if the lower bound of its confidence is above the verdict's share of all labelled
pages, so that it says more than chance, and if none with one token less says the same as surely. The surest that fits
decides. They are matched through an inverted index on their rarest token, once per distinct set of tokens, of which
there are far fewer than urls.

Tokens that stand in the same labelled pages, as those of a template do, are one to FP-growth, which would otherwise
list all their subsets.

Defined cases: a null url, or one without `://`, has an empty host and path, no tokens, and is allowed; without labelled
pages no rule is mined; repeated pages get the same verdict; a page with several labels is bad if one of them is; of
equally sure rules the one with the higher lift decides, then `block`; a very long url has as many tokens as it has parts;
an empty table gives an empty result; other columns are kept whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_names, small, stored

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
BLOCK, ALLOW = "block", "allow"
#: Standard errors by which a rule's confidence must exceed the verdict's share.
SURE = 2.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(size, rule, verdict) of the longest given rule that fits, else null. The host's own suffixes are looked up
    in a map of the rules, so the work does not grow with their number."""
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    entry = lambda r: F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))
    known = F.create_map(*(x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(entry, rs)))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(known, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, the host and its labels, segments of the path, names of the query's parameters, and
    whether there is a fragment. Digits are all alike but in hosts."""
    host, path = host_path(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    exact = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    tag = lambda kind, items: exact(kind, F.transform(items, lambda x: F.regexp_replace(x, "[0-9]+", "0")))
    parts = [
        tag("s:", F.array(F.regexp_extract(url, "^([^:/?#]*)://", 1))),
        exact("host:", F.array(host)),
        exact("h:", F.split(host, r"\.")),
        tag("p:", F.split(path, "[/.]")),
        tag("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(F.concat(*parts)))).otherwise(F.array().cast("array<string>"))


def _distinct_tokens(rows: DataFrame) -> DataFrame:
    """t: of the tokens that stand in the same rows (id, tokens), the first."""
    both = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    each = rows.select("id", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), *both)
    return each.groupBy("n", "x1", "x2").agg(F.min("t").alias("t")).select("t")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, lift, support) from rows (tokens, bad)."""
    spark = labelled.sparkSession
    schema = "antecedent array<string>, verdict string, confidence double, lift double, support double"
    rows = stored(labelled.filter(F.size("tokens") > 0).select("tokens", F.when(F.col("bad"), BLOCK).otherwise(ALLOW).alias("verdict")), "url-labelled")
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()), "url-numbered")
    n, bad = rows.agg(F.count("*"), F.count_if(F.col("verdict") == BLOCK)).first()
    if not n:
        return spark.createDataFrame([], schema)
    kept = stored(_distinct_tokens(rows), "url-tokens")
    items = rows.select("id", "verdict", F.explode("tokens").alias("t")).join(small(kept), "t").groupBy("id", "verdict").agg(F.collect_list("t").alias("items"))
    items = stored(items.select(F.concat("items", F.array(F.concat(F.lit("="), "verdict"))).alias("items")), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    said = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("=")))
    rules = said.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 99).alias("verdict"), "confidence", "lift", "support")
    share = F.when(F.col("verdict") == BLOCK, bad / n).otherwise(1 - bad / n)
    rules = stored(rules.filter(lower_bound(F.col("confidence"), F.round(F.col("support") * n / F.col("confidence"))) > share), "url-rules")
    # a rule goes if one with a token less is at least as sure
    less = rules.select("antecedent", "verdict", "confidence", F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x))).alias("part"))
    of = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    beaten = less.join(of, ["part", "verdict"]).filter("of_part >= confidence").select("antecedent", "verdict").distinct()
    return rules.join(beaten, ["antecedent", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "lift", "support")


def lower_bound(share: Column, n: Column, z: float = SURE) -> Column:
    """Wilson's lower bound of a share of n."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def match(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """pattern, and verdict, confidence, lift and antecedent of the surest rule that it holds, from rows (pattern, tokens)."""
    rules = stored(rules, "url-kept-rules")
    used = stored(rules.select(F.explode("antecedent").alias("t")).distinct(), "url-used")
    each = patterns.select("pattern", "tokens", F.explode("tokens").alias("t")).join(small(used), "t")
    common = stored(each.groupBy("t").agg(F.count("*").alias("n")), "url-index")
    index = rules.select("*", F.explode("antecedent").alias("t")).join(small(common), "t", "left")
    index = stored(index.groupBy(*rules.columns).agg(F.min_by("t", F.struct(F.coalesce("n", F.lit(0)), "t")).alias("t")), "url-inverted")
    hits = each.join(small(index), "t").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy("pattern").agg(F.max(F.struct("confidence", "lift", "verdict", "antecedent")).alias("b"))
    return best.select("pattern", "b.*")


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The pages with struct column `judged`: host, path, rule, verdict, and of a mined rule that fits its verdict, confidence,
    lift and tokens. labels: page_id and bad (boolean)."""
    name = own_names(pages, "pattern", "host", "path", "given", "verdict", "confidence", "lift", "antecedent")
    toks = tokens(F.col("url"))
    bad = labels.groupBy("page_id").agg(F.bool_or("bad").alias("bad")).filter("bad IS NOT NULL")
    found = mine(pages.select("page_id", toks.alias("tokens")).join(bad, "page_id").select("tokens", "bad"), min_support, min_confidence)
    patterns = stored(pages.select(toks.alias("tokens")).groupBy("tokens").agg(F.lit(1).alias("one")).select(F.xxhash64("tokens").alias("pattern"), "tokens"), "url-patterns")
    found = stored(match(patterns, found), "url-matched").withColumnsRenamed({k: name[k] for k in ("pattern", "verdict", "confidence", "lift", "antecedent")})
    host, path = host_path(F.col("url"))
    out = pages.withColumn(name["pattern"], F.xxhash64(toks)).join(small(found), name["pattern"], "left")
    out = out.withColumn(name["host"], host).withColumn(name["path"], path)
    out = out.withColumn(name["given"], fitting_rule(F.col(name["host"]), F.col(name["path"]), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>"))
    given = F.col(name["given"])
    mined = {k: F.col(name[k]) for k in ("verdict", "confidence", "lift", "antecedent")}
    verdict = F.coalesce(given["verdict"], mined["verdict"], F.lit(ALLOW))
    judged = F.struct(F.col(name["host"]).alias("host"), F.col(name["path"]).alias("path"), given["rule"].alias("rule"), verdict.alias("verdict"), mined["verdict"].alias("mined"), mined["confidence"].alias("confidence"), mined["lift"].alias("lift"), mined["antecedent"].alias("tokens"))
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), judged.alias("judged"))
