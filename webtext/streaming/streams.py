"""Structured Streaming: sources, sinks and stateless extraction (T1); sessions, answers and windows are in modules of their own.

Sources are file streams (new Parquet files of pages / turns); sinks are
Parquet folders with a checkpoint under the session's checkpoint directory,
so a restarted job resumes exactly once. ``availableNow`` processes what is
there and stops, which is how the registered queries and tests drive them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.pages import extract_pages
from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(path)


def run_to_parquet(stream: DataFrame, name: str, spark: SparkSession) -> str:
    """Run a stream to a Parquet sink until the input available now is done."""
    out = scratch_path(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .option("path", out + "/data")
        .option("checkpointLocation", out + "/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return out + "/data"


# -- T1 ---------------------------------------------------------------------


def stream_extract(pages_stream: DataFrame, parallelism: int | None = None) -> DataFrame:
    """The batch extractor on a stream of stored responses (stateless).

    A micro-batch read from few files arrives in few partitions; it is spread
    round-robin over ``parallelism`` tasks before the CPU-bound parse."""
    n = parallelism or pages_stream.sparkSession.sparkContext.defaultParallelism
    return extract_pages(pages_stream.repartition(n), keep=["page_id"], spread=False)


# -- micro-batches ----------------------------------------------------------


def write_epochs(
    stream: DataFrame,
    answer: Callable[[DataFrame, int], DataFrame],
    out_path: str,
    checkpoint: str,
    mode: str = "append",
):
    """Run a batch plan ``(rows, epoch) -> rows`` on every micro-batch and
    write its rows to ``out_path/epoch_id=<n>`` (``foreachBatch``; the
    per-request ordered aggregation is not a streaming aggregate). Each epoch
    overwrites its own folder, so a replayed epoch after a failure does not
    duplicate rows. The micro-batch is persisted while the plan reads it
    several times."""

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()
        try:
            answer(batch, epoch_id).write.mode("overwrite").parquet(f"{out_path}/epoch_id={epoch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(per_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query dropped as later than its watermark, over its recorded progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after every recorded micro-batch."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
