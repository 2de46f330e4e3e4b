"""A training corpus from documents: toxicity, near-duplicates, secrets, mixing, SentencePiece.

Every stage reads what the one before wrote. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import mixing, neardup, secrets, sentencepiece_trie, toxicity
from alertloom.llm.common import Scratch, free_name, table

TOXIC_AT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores at TOXIC_AT or more go; labels of held-out rows are not learned."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held))
    name = free_name("toxicity", docs)
    return toxicity.score_rows(docs, lexicon, score_col=name).filter(F.col(name) < TOXIC_AT).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id. Rows are compared, not ids: of
    rows that share a doc_id, copies go and differing texts stay."""
    return neardup.distinct_documents(docs, percent=85)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced; n_chars, if a column, counts the new text."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.materialise(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip)."""
    return sentencepiece_trie.encode_rows(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("sentencepiece", encode)]

#: No stage but mixing can be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
