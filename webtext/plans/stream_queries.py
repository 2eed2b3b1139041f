"""Registered streaming queries (T1-T3): file streams over the driver tables,
run with ``availableNow`` into Parquet sinks under the checkpoint directory,
returned as the sink's rows. Each equals its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_length, validate_content, word_count
from ..operators import summarize as S
from ..operators.completers import lead_text, replay_completer
from ..operators.pages import extract_pages
from ..session import scratch_path
from ..sources import derived as D
from ..sources.tables import load_conversations, load_documents, load_events, load_pages, page_columns
from ..streaming.answers import decided_requests, split_decided
from ..streaming.sessions import CHANGES, kept_lines, rocksdb_state, session_changes
from ..streaming.streams import file_stream, run_to_parquet, stream_extract, write_epochs
from ..streaming.windows import host_windows, latest_windows, line_sessions, summary_windows
from .answer import answer_requests, library_registry


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table's file as a file stream. A stream source takes a folder or a
    glob; the one-file glob ``name.parque[t]`` keeps the read to that file."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    return file_stream(spark, path[:-1] + "[t]", spark.read.parquet(path).schema)


def stream_extract_q(spark: SparkSession, sf: str) -> DataFrame:
    recs = stream_extract(page_columns(_stream(spark, sf, "pages")))
    out = run_to_parquet(recs, "stream-extract", spark)
    r = spark.read.parquet(out)
    return r.select(
        "page_id", "url", "title", "content", "clean_text",
        F.size("links").cast("long").alias("n_links"),
        F.size("images").cast("long").alias("n_images"),
        F.size("metadata").cast("long").alias("n_meta"),
        F.array_join("links", "\n").alias("links_text"),
        "status_code", "content_type",
    )


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose ``ts`` a watermark can follow."""
    return load_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _line_stream(spark: SparkSession, sf: str, exits: bool) -> DataFrame:
    """User lines with the time of event ``conv_id * 31 + turn`` as ``at``."""
    conv = _stream(spark, sf, "conversations")
    lines = D.session_lines(conv) if exits else conv
    lines = lines.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    return D.with_event_time(lines, _events(spark, sf), F.pmod(F.col("conv_id"), F.lit(1000003)) * 31 + F.pmod(F.col("turn"), F.lit(1009)), "at")


def _sessions(spark: SparkSession, sf: str, exits: bool) -> DataFrame:
    """T2 over the conversations, to the end of the stream; its kept lines."""
    base = scratch_path(spark, "stream-sessions")
    changes = session_changes(_line_stream(spark, sf, exits), "at")
    with rocksdb_state(spark):
        write_epochs(changes, lambda batch, epoch: batch, base + "/data", base + "/checkpoint", "update").awaitTermination()
    return kept_lines(spark.read.schema(CHANGES + ", epoch_id long").parquet(base + "/data"))


def stream_sessions_q(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf, exits=True)


#: The rows of the given tables lie in 30 days, in no order of time; a beat after all of them closes the streams.
DELAY, WAIT, BEAT, BEAT_ID = "31 days", "1 hour", "INTERVAL 100 days", "beat"


def _staged(rows: DataFrame, time_col: str, path: str, files: int, key: str = "request_id") -> DataFrame:
    """``rows`` as a stream of files, then a beat far after the last time. (It has an id:
    Spark drops rows that can't join before they count for the watermark.)"""
    rows.repartition(files, F.xxhash64(F.lit(files), key)).write.parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    beat = stored.agg((F.coalesce(F.max(time_col), F.current_timestamp()) + F.expr(BEAT)).alias(time_col))
    columns = {time_col: F.col(time_col)} | ({key: F.lit(BEAT_ID)} if rows.schema[key].dataType == T.StringType() else {})
    beat.select(*[columns.get(c, F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns]).write.mode("append").parquet(path)
    return file_stream(rows.sparkSession, path, rows.schema)


def stream_answer_q(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that T2 keeps are a stream of requests, their decisions a second one."""
    pages, events = load_pages(spark, sf), _events(spark, sf)
    registry, ctx = library_registry(), {"pages": pages, "documents": load_documents(spark, sf)}
    base = scratch_path(spark, "stream-answer")
    turns = _sessions(spark, sf, exits=False).withColumn("role", F.lit("user"))
    req = D.with_event_time(D.user_requests(turns), events, D.request_seed(), "asked_at").select("request_id", "user_text", "asked_at")
    requests = _staged(req, "asked_at", base + "/requests", 4)
    written = spark.read.schema(req.schema).parquet(base + "/requests").where(F.col("request_id") != BEAT_ID)
    # a decision comes within an hour, before or after others that were asked for later
    made = D.decisions(written, pages).join(written.select("request_id", "asked_at"), "request_id")
    made = made.withColumn("decided_at", F.col("asked_at") + F.make_dt_interval(mins=(D.request_seed() % 60).cast("int"))).drop("asked_at")
    decisions = _staged(made, "decided_at", base + "/decisions", 3)

    def answer(batch: DataFrame, epoch_id: int) -> DataFrame:
        own, came = split_decided(batch.where(F.col("request_id") != BEAT_ID))
        return answer_requests(own, came, registry, ctx, replay_completer(D.post_completions(own)))

    joined = decided_requests(requests, decisions, DELAY, WAIT)
    write_epochs(joined, answer, base + "/data", base + "/checkpoint").awaitTermination()
    return spark.read.parquet(base + "/data").drop("epoch_id")


# -- M1-M3 in windows of event time -----------------------------------------------


def _run_windows(spark: SparkSession, windows: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Runs a windowed stream to its end; all versions of its windows."""
    base = scratch_path(spark, name)
    write_epochs(windows, lambda batch, epoch: batch, base + "/data", base + "/checkpoint", mode).awaitTermination()
    return spark.read.schema(windows.schema.add("epoch_id", "long")).parquet(base + "/data")


def stream_host_windows_q(spark: SparkSession, sf: str) -> DataFrame:
    """M1 per day, host and status; a page was fetched at event ``page_id * 7``."""
    pages = D.with_event_time(page_columns(_stream(spark, sf, "pages")), _events(spark, sf), F.col("page_id") * 7, "fetched_at")
    records = extract_pages(pages, keep=["page_id", "fetched_at"])
    return latest_windows(_run_windows(spark, host_windows(records, "fetched_at", delay=DELAY), "host-windows"), ["window_start", "window_end", "host", "status_code"])


def stream_summary_windows_q(spark: SparkSession, sf: str) -> DataFrame:
    """M2 per day and style of the lead summaries; a document came at event ``doc_id * 11``."""
    docs = D.with_event_time(_stream(spark, sf, "documents"), _events(spark, sf), F.col("doc_id") * 11, "at")
    own = docs.select("at", F.col("text").alias("content"), (F.col("doc_id") % 4 * 50).cast("int").alias("max_length"), D.summary_style().alias("style"))
    own = S.request_defaults(own.withColumn("language", F.lit("")))
    summary = lead_text(F.col("content"), F.col("max_length"))
    sized = own.select("at", "style", byte_length("content").alias("original_size"), byte_length(summary).alias("summary_size"), word_count(summary).alias("tokens_used"),
                       validate_content(F.col("content"), word_count(F.col("content"))).alias("error"))
    return latest_windows(_run_windows(spark, summary_windows(sized, "at", delay=DELAY), "summary-windows"), ["window_start", "window_end", "style"])


def stream_line_sessions_q(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of user lines that are at most ten minutes apart, closed by a beat after all lines."""
    lines = D.with_event_time(load_conversations(spark, sf).where(F.col("role") == "user"), _events(spark, sf), F.pmod(F.col("conv_id"), F.lit(1000003)) * 31 + F.pmod(F.col("turn"), F.lit(1009)), "at")
    staged = _staged(lines.select("conv_id", "text", "at"), "at", scratch_path(spark, "lines"), 4, "conv_id")
    return _run_windows(spark, line_sessions(staged, "at", "10 minutes", DELAY), "line-sessions", "append").drop("epoch_id")
