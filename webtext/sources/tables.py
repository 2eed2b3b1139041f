"""Table sources: the crawl snapshot, document corpus and conversation log.

Every loader selects only the columns it needs so the Parquet scan prunes
(`ReadSchema` in the plan) and filters given later push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations".split()
)


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_scan(df) if spread else df


def spread_scan(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan that arrives in fewer splits than cores;
    only where the caller asks for it (``spread=True``).

    The work on these tables is CPU-heavy per row (HTML parsing, regex over
    whole texts), so a small table stored as one row group would otherwise run
    in one task up to the first shuffle. A large scan already has at least
    ``defaultParallelism`` splits and is returned unchanged (no shuffle).
    Counting the partitions of a plain scan plans it without running it.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def load_pages(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """One stored response per row. ``status_code`` / ``content_type`` pass
    through when the snapshot has them, else NULL (the HTML path is taken)."""
    return page_columns(read_table(spark, sf_dir, "pages", spread))


def page_columns(df: DataFrame) -> DataFrame:
    """The snapshot columns the extractor reads (works on batch and stream frames)."""
    cols = set(df.columns)
    return df.select(
        "page_id",
        "url",
        "html",
        (F.col("status_code").cast("int") if "status_code" in cols else F.lit(None).cast("int")).alias("status_code"),
        (F.col("content_type") if "content_type" in cols else F.lit(None).cast("string")).alias("content_type"),
    )


def load_documents(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return read_table(spark, sf_dir, "documents", spread).select("doc_id", "text", "lang", "source", "n_chars")


def load_conversations(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return read_table(spark, sf_dir, "conversations", spread).select("conv_id", "turn", "role", "text")


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
