"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, embedding_dedup, jaccard, language_id, line_dedup, manifest, mixing, oracles, quality_pu, quality_rules, substring_dedup, url_filter
from .common import n_words, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(language_id.fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held).select("text", "lang"))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.dedup_lines(docs, n_lines="n_lines", n_removed="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The rules given for pages.
PAGE_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the document of its id is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), PAGE_RULES, bad)
    return out.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.mined", "judged.confidence", "judged.lift", F.array_join("judged.tokens", " ").alias("tokens"))


def byte_bpe() -> str:
    """The tokenizer file, read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), byte_bpe(), ["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = quality_pu.stored_features(table(spark, sf_dir, "documents"))
    held = F.coalesce(language_id.fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held).select("doc_id", "quality")
    model = quality_pu.train(feats.filter(~held), labels)
    return quality_pu.score(feats, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.POLICIES["base"]))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits", "n_capitals", "n_lines", "n_stutter")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the last policy removes, and what it alone does, from the ledger."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    each = plan.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that each source gives to the mix."""
    docs = table(spark, sf_dir, "documents")
    sources = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    return mixing.targets(sources, 1.5, 2.0).select("source", "source_size", F.round("target", 3).alias("target"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the manifest with its proof, checked against copies of which some lost their line breaks."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    seen = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = manifest.manifest(docs, fields, {"doc_id": F.col("doc_id"), "seen": manifest.leaf(*(F.col(c) for c in fields[:-1]), seen)})
    folded = manifest.fold(F.col("seen"), F.col("steps"))
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_nearest": op6_nearest,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrase_collocations": op13_phrase_collocations,
    "rule_ablations": rule_ablations,
    "mixing_targets": mixing_targets,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": oracles.LINE_DEDUP,
    "op7_quality_rules": oracles.QUALITY_RULES,
    "rule_ablations": oracles.RULE_ABLATIONS,
    "mixing_targets": oracles.MIXING_TARGETS,
    "op8_jaccard_join": oracles.JACCARD,
    "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op11_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op12_merkle_manifest": oracles.MANIFEST,
    "op13_phrase_collocations": oracles.COLLOCATIONS,
}
