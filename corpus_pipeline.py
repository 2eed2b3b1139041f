"""The corpus pipeline: documents to packed training sequences.

Language ID, exact dedup, SimHash near-dedup and suffix-array dedup each pass
on the columns of ``documents``; packing returns its pieces. Every stage works
on all rows that the one before it kept and is written as Parquet under
``spark.checkpoint.dir`` before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm import exact_dedup, language_id, packing, simhash, suffix_dedup
from webtext.llm.common import materialise, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``) go; every other text has a language, however unclear, and stays."""
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_known(docs, model)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_one(docs)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text loses the strings of 100 bytes that start earlier in the corpus."""
    return suffix_dedup.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_fingerprints),
    ("suffix_array_dedup", without_repeats),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL has no support vector machine, suffix array or tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
