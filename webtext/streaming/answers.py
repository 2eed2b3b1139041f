"""Answers on streams (T3): requests and decisions arrive on streams of their own and are joined.

A request waits for its decision until the watermark has passed its time by
``wait``; then its state is removed and it goes on without one, which the answer
plan reports as a missing completion. Decisions that find no request in that time are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISION = ["n_choices", "content", "model", "prompt_tokens", "completion_tokens", "total_tokens", "error"]


def decided_requests(requests: DataFrame, decisions: DataFrame, delay: str = "1 hour", wait: str = "1 hour") -> DataFrame:
    """Stream of requests (request_id, ..., asked_at) and of decisions (request_id, DECISION, decided_at) -> every request once, with ``decision`` (struct, NULL if it never came).

    Either may arrive first. ``delay`` is how late a row may come on its stream.
    """
    asked = requests.withWatermark("asked_at", delay)
    made = decisions.select(F.col("request_id").alias("_for"), "decided_at", F.struct(*DECISION).alias("decision")).withWatermark("decided_at", delay)
    same = (F.col("request_id") == F.col("_for")) & (F.col("decided_at") >= F.col("asked_at")) & (F.col("decided_at") <= F.col("asked_at") + F.expr(f"INTERVAL {wait}"))
    return asked.join(made, same, "leftOuter").drop("_for", "decided_at")


def split_decided(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A micro-batch of :func:`decided_requests` -> (requests, completions of the decisions that came)."""
    return batch.drop("decision", "asked_at"), batch.where(F.col("decision").isNotNull()).select("request_id", "decision.*")
