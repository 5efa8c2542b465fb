"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. Policies are
versioned masks over those bits, so that a new policy, or the question what a rule alone costs, needs no second look at
the texts: both are bitwise operations and aggregations over the ledger. Only DataFrame functions are used.

Defined cases: a null or empty text has no words and fails `few_words`; a null doc_id stays null; repeated rows give
repeated ledger rows; an empty table gives an empty ledger; other columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Rule name -> condition over the measurements. The position is the bit; new rules are appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "capitals": "10 * n_capitals > 3 * word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "stutter": "10 * n_stutter > 2 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}

#: Policy version -> the rules that it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def mask(rules: tuple[str, ...] | list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Number of words in windows whose hash occurs twice or more."""

    def repeated(by_hash: Column) -> Column:
        n = F.size(by_hash)

        def same(j: Column, k: Column) -> Column:
            return F.coalesce(F.get(by_hash, j)["h"] == F.get(by_hash, k)["h"], F.lit(False))

        at = F.filter(F.sequence(F.lit(0), n - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(at, lambda j: F.get(by_hash, j)["i"]))

    sortable = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate(
        _let(sortable, repeated),
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    # most texts repeat no window; a hash set shows that without sorting
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(total)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits, a row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    one = base.select(
        "doc_id",
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    h, n = F.col("h"), F.size("h")
    two = one.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n < 2, 0)
        .otherwise(F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(h, i) == F.get(h, i - 1))))
        .cast("long")
        .alias("n_stutter"),
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    three = two.withColumn("n_repeat_words", _covered(F.col("windows")).cast("long")).drop("windows")
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)) for k, cond in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return three.withColumn("fail_bits", total.cast("long"))


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """Adds `kept`: none of the policy's rules failed."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those which only it removes (they would come back without it).

    The ledger is first summed by bit pattern, of which there are at most 2 to the number of rules."""
    of = mask(POLICIES[version])
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(of)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[version]))
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit & (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("failed_alone"),
    )
