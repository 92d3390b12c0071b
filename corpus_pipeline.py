"""From raw documents to packed token windows: quality rules, near duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; `run` writes each to the shared folder and reads it back as the
next one's input. All but the last return the columns of `documents`, whatever further ones there are.

Defined results. Null or empty texts, or such without words: they fail the rules and go in the first stage. Null ids: the document
is judged like any other; of a group of near duplicates it stays only if no other member has an id. Repeated rows: one of them
stays. Null sources are a source. Empty table: no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import host_quality, mixing, ngram_join, packing, pii
from seqloom.llm import words as W
from seqloom.session import discard, stored

ORACLE_SQL = None  # packing needs the tokenizer; tests/llm compares every stage with a plain version of it


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return host_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; five words and 0.8, the usual setting."""
    return ngram_join.keep_first(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind."""
    rows = pii.redact(docs)
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else rows


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix reads them."""
    return W.shielded(docs, lambda rows: mixing.mix(rows, whole=True).select(*rows.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    pieces = packing.pack(docs, packing.default_tokenizer(), keep_ids=False)
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
