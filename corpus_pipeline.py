"""Corpus pipeline: quality rules, exact dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; what it returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup, near_dedup, packing, quality
from marginalia.llm.common import saved, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line rule keep, without their common lines."""
    kept = quality.judged(docs).where("kept")
    text = F.col("clean_text")
    n_chars = F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return kept.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.exact_duplicates(docs).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.without_near_duplicates(docs, width=5, percent=80).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack_documents(docs, "byte_bpe_50k.json", separator=0, capacity=2048)


STAGES = [("quality rules", quality_rules), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("packing", pack)]

#: Shingling, signatures and tokenization are beyond SQL: see the brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
