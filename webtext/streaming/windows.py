"""M1-M3 on streams: tumbling and session windows over event time, with late rows dropped and counted.

A window's state is removed when the watermark has passed its end. Tumbling windows run in
update mode, where every micro-batch puts out the windows that it changed and :func:`latest_windows`
keeps the last version of each, or in append mode; sessions, which grow and join, in append mode,
where a window is put out once, when it is closed. ``late_rows`` (streams) counts what came too late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_length, word_count


def host_windows(records: DataFrame, time_col: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """M1 per tumbling window, host and status, on a stream of page records (url, clean_text, links, images, status_code, extract_error)."""
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    grouped = records.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), host.alias("host"), "status_code")
    return _bounds(grouped.agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(byte_length("clean_text")).cast("long").alias("bytes"),
        F.sum(F.size("links")).cast("long").alias("links"),
        F.sum(F.size("images")).cast("long").alias("images"),
        F.count("extract_error").alias("failures"),
    ), "host", "status_code", "pages", "bytes", "links", "images", "failures")


def summary_windows(responses: DataFrame, time_col: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """M2 per tumbling window and style, on a stream of summary responses (style, original_size, summary_size, tokens_used, error)."""
    grouped = responses.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), "style")
    return _bounds(grouped.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("original_size").cast("long").alias("bytes_in"), F.sum("summary_size").cast("long").alias("bytes_out"),
        F.sum("tokens_used").cast("long").alias("tokens"), F.count("error").alias("failures"),
    ), "style", "rows", "bytes_in", "bytes_out", "tokens", "failures")


def line_sessions(lines: DataFrame, time_col: str, gap: str = "6 hours", delay: str = "2 days") -> DataFrame:
    """M3's dimension for lines: per conversation and session window (lines at most ``gap`` apart) the lines and words."""
    grouped = lines.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), "conv_id")
    return _bounds(grouped.agg(F.count(F.lit(1)).alias("lines"), F.sum(word_count(F.col("text"))).cast("long").alias("words")), "conv_id", "lines", "words")


def _bounds(windows: DataFrame, *columns: str) -> DataFrame:
    def plain(c: str) -> Column:
        return F.col(f"w.{c}").cast("timestamp_ntz").alias(f"window_{c}")

    return windows.select(plain("start"), plain("end"), *columns)


def latest_windows(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Of a table of window versions (``epoch_id``) the last one of each window and key, NULL keys too."""
    values = [c for c in epochs.columns if c not in (*keys, "epoch_id")]
    last = epochs.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch_id").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
