"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, BPE encoding, over `documents`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written as Parquet in the shared folder and read again.

Defined cases: documents whose language cannot be told (no letters, null text) go in the first stage, whatever else they
have; documents emptied of boilerplate stay, empty; of a group of near duplicates one row stays, the one with the
smallest doc_id (null last), then of the smallest hash of its text, then of its row, also where ids or rows repeat; the mix repeats documents, so that doc_ids repeat after it; very long texts are
documents like others; empty tables pass through; nulls are treated as each operator says. Extra columns of documents are kept up to the mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.frames import row_hash
from tessera.llm import bpe, jaccard, language_id, line_dedup, mixing
from tessera.llm.common import own_names, small, stored, table
from tessera.llm.queries import byte_bpe


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told, having no letters or only such of scripts that no language was
    learned with; learns from the labelled languages of all."""
    name = own_names(docs, "lang_pred", "score", "spans")
    model = language_id.fit(docs.select("text", "lang"))
    told = language_id.identify(docs, model, lang_pred=name["lang_pred"], score=name["score"], spans=name["spans"])
    kept = (F.col(name["lang_pred"]) != language_id.UNDETERMINED) & (F.col(name["score"]) > 0)
    return told.filter(kept).select(*(f"`{c}`" for c in docs.columns))


def key(docs: DataFrame) -> Column:
    """Names a row, whatever ids repeat or are null; only rows that are equal in all columns share it. In its order come
    smaller doc_ids first and null last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), row_hash(docs).alias("row"))


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that stand on many sources and in many documents, of which copies of each other are one, to the
    letter or not."""
    body = own_names(docs, "body")["body"]
    told = stored(line_dedup.bodies(docs, name=body), "pipeline-bodies")
    out = line_dedup.dedup_lines(told, body=body).drop(body)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the first by `key`; documents without a word all stay."""
    found = jaccard.near_duplicates(docs.select(key(docs).alias("doc_id"), "text"), n=5, num=80, den=100)
    found = found.filter("n_shingles > 0").select(F.col("doc_id").alias("k"), (F.col("doc_id") == F.col("component_id")).alias("first"))
    found = stored(found.groupBy("k", "first").count(), "pipeline-duplicates")
    name = own_names(docs, "own", "gone")
    own, gone = F.col(name["own"]), F.col(name["gone"])
    keyed = docs.withColumn(name["own"], key(docs))
    marked = lambda rows: small(found.filter(rows).select(F.col("k").alias(name["gone"])))
    kept = keyed.join(marked("NOT first OR count > 1"), own == gone, "left_anti")
    one = keyed.join(marked("first AND count > 1"), own == gone, "left_semi").dropDuplicates([name["own"]])
    return kept.unionByName(one).drop(name["own"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents such that sources have their target shares."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, packed as little-endian unsigned 32-bit integers."""
    return bpe.encode(docs, byte_bpe(), ["doc_id", "source"]).select("doc_id", "source", "n_tokens", "ids")


STAGES = [("language ID", languages), ("line dedup", boilerplate), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("BPE", encode)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
