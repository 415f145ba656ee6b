"""From raw documents to packed training sequences: the stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import language_id, near_duplicates, packing, pii, toxicity
from rostrum.llm.tools import prepared, stored, table

# not expressible in SQL: trained models, keyed permutations; tests compare the stages with brute force
ORACLE_SQL = None
# ids of documents to drop, up to this number, are broadcast (8 bytes each)
BROADCAST_IDS = 300_000


def _set_aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with other names for columns called like an operator's results, and the way back."""
    moved = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(moved), {new: old for old, new in moved.items()}


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; empty, letterless and garbled texts go."""
    prepared(spark)
    models, calibration = language_id.language_models(docs.select("doc_id", "text", "lang"))
    own, back = _set_aside(docs, {"lang_pred", "score", "rejected"})
    out = language_id.identify_languages(own, models, calibration)
    return out.filter(~F.col("rejected")).select(*own.columns).withColumnsRenamed(back)


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    prepared(spark)
    own, back = _set_aside(docs, {"score", "predicted", "__words"})
    out = toxicity.judged(own, table(spark, sf_dir, "labels"))
    return out.filter("predicted = 0").select(*own.columns).withColumnsRenamed(back)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id; of rows with one id the smallest row."""
    prepared(spark)
    groups = stored(near_duplicates.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept"), "groups")
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    again = groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    out = docs.join(small(gone), "doc_id", "left_anti")
    if again.isEmpty():
        return out
    again = small(again)
    row = F.min(F.struct(*docs.columns)).alias("row")
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).union(
        out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("row.*"))


def pseudonymous_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows where the text changed."""
    prepared(spark)
    own, back = _set_aside(docs, {"pii"})
    out = pii.pseudonymise(own, pii.QUERY_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*own.columns).withColumnsRenamed(back)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most 2048 tokens."""
    prepared(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_languages),
    ("toxicity", civil_documents),
    ("near_duplicates", distinct_documents),
    ("pii", pseudonymous_documents),
    ("packing", packed_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
