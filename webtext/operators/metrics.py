"""Run metrics (M1-M3): the per-call log events of the original tool as grouped
aggregates. All are hash aggregations with map-side partial combine, so a hot
group key ships one partial row per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import byte_length


def extract_metrics(rows: DataFrame) -> DataFrame:
    """M1: per host and status: pages, clean-text bytes, links, images, failures."""
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return rows.groupBy(host.alias("host"), F.col("status_code")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(byte_length("clean_text")).cast("long").alias("bytes"),
        F.sum(F.size("links")).cast("long").alias("links"),
        F.sum(F.size("images")).cast("long").alias("images"),
        F.count("error").alias("failures"),
    )


#: levels of :func:`extract_rollup`, coarsest last
ROLLUP = [["tld", "domain", "host", "status_code"], ["tld", "domain", "host"], ["tld", "domain"], ["tld"], []]


def extract_rollup(rows: DataFrame) -> DataFrame:
    """M1 at all levels of the host's suffix chain in one pass: host and status, host, domain (last two labels),
    top-level domain, all. ``level_id`` is Spark's ``grouping_id``: a bit for each of (tld, domain, host,
    status_code) that the row sums over, so a NULL key of a row is told from a level's missing key. Distinct URLs are
    counted per level in the same expand."""
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    labels = F.split(host, r"\.")
    keyed = rows.select(
        F.element_at(labels, -1).alias("tld"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        host.alias("host"), "status_code", "url", byte_length("clean_text").alias("_bytes"), F.size("links").alias("_links"), "error")
    names = ROLLUP[0]
    return keyed.groupingSets([[F.col(c) for c in level] for level in ROLLUP], *[F.col(c) for c in names]).agg(
        F.grouping_id(*names).cast("long").alias("level_id"),
        F.count(F.lit(1)).alias("pages"), F.count_distinct("url").alias("urls"),
        F.sum("_bytes").cast("long").alias("bytes"), F.sum("_links").cast("long").alias("links"), F.count("error").alias("failures"))


def summary_metrics(responses: DataFrame) -> DataFrame:
    """M2: per model and style: rows, bytes in / out, tokens, failures."""
    return responses.groupBy("model", "style").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("original_size").cast("long").alias("bytes_in"),
        F.sum("summary_size").cast("long").alias("bytes_out"),
        F.sum("tokens_used").cast("long").alias("tokens"),
        F.count("error").alias("failures"),
    )


def agent_metrics(decided: DataFrame) -> DataFrame:
    """M3: per route: decisions, proposed calls, parse failures, low-confidence decisions."""
    return decided.groupBy("route").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.size("decision.tool_calls")).cast("long").alias("calls"),
        F.count(F.when(~F.col("parse_ok"), 1)).alias("parse_failures"),
        F.count(F.when(F.col("decision.confidence") < 0.5, 1)).alias("low_confidence"),
    )


def observe_agent_metrics(decided: DataFrame, name: str = "agent_metrics") -> tuple[DataFrame, Observation]:
    """M3 without a separate job: the same totals as :func:`agent_metrics`
    (over all routes) collected by ``DataFrame.observe`` while the decided
    rows flow into whatever action runs next. Read them with ``obs.get``
    after that action."""
    obs = Observation(name)
    observed = decided.observe(
        obs,
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum(F.size("decision.tool_calls")), F.lit(0)).cast("long").alias("calls"),
        F.count(F.when(~F.col("parse_ok"), 1)).alias("parse_failures"),
        F.count(F.when(F.col("decision.confidence") < 0.5, 1)).alias("low_confidence"),
    )
    return observed, obs
