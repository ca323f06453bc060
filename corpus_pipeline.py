"""From raw documents to token ids: language ID, line dedup, near dedup, decontamination, byte-level BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that go on, with the
columns of ``documents``; the last one returns ids' digests. Every stage works on what its predecessor kept. Empty input
gives empty output; each operator's docstring defines nulls, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from quarry.llm.common import crc_fold, documents, free, small_batches, spool


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (no letters, or far from every language) go."""
    small_batches(spark)
    model = language_id.train(docs.where(crc_fold(F.col("doc_id"), 5) != 0))
    return language_id.filter_language(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which nothing is left."""
    small_batches(spark)
    number, which = free(docs, "n_lines_gone", "lines_gone")
    out = line_dedup.dedup_lines(docs, added=(number, which))
    return out.where((F.col(number) == 0) | (F.col("text") != "")).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' number and digest, and the digest of the decoded bytes."""
    small_batches(spark)
    # the stages before have left the executors' memory full: remember less
    return bpe.bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, max_states=40_000, max_pieces=50_000)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("byte_bpe", token_stage)]

#: SQL can't express the classifier, the signatures or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
