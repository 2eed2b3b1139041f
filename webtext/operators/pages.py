"""Page extraction (P1-P15) as DataFrame jobs.

``extract_pages`` is the only Python step: a ``mapInArrow`` over
(url, html[, selector, content_type]) that parses each page once. Everything
after it (clean text, stats, batches, tool responses) is Catalyst.
Column pruning and filters must happen *before* it -- a Python step blocks
pushdown -- so callers select/filter first and the function itself keeps only
the columns it needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_length, byte_prefix, clean_lines
from ..session import ship_package, written_table
from ..sources.tables import spread_scan
from .asof import asof_join
from .lookup import wanted_rows

PAGE_FIELDS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("matched_selector", T.StringType()),
        T.StructField("selector_used", T.BooleanType()),
        T.StructField("extract_error", T.StringType()),
    ]
)

_ARROW_FIELDS = [
    pa.field("title", pa.string()),
    pa.field("content", pa.string()),
    pa.field("links", pa.list_(pa.string())),
    pa.field("images", pa.list_(pa.string())),
    pa.field("metadata", pa.map_(pa.string(), pa.string())),
    pa.field("matched_selector", pa.string()),
    pa.field("selector_used", pa.bool_()),
    pa.field("extract_error", pa.string()),
]

PREVIEW_BYTES = 500
EXTRACT_ROWS, EXTRACT_BYTES = 64, 4 << 20  # pages whose records a worker holds at a time, and their HTML
#: a wanted (url, key, selector) in a broadcast table, about; decides the way to the hits, not the hits
TARGET_BYTES = 200


def _page_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most EXTRACT_ROWS pages and, but for a single larger page, EXTRACT_BYTES of HTML.

    A batch has up to 10,000 rows at the default of ``spark.sql.execution.arrow.maxRecordsPerBatch``;
    its pages as Python objects and all their records would be many times its size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start == EXTRACT_ROWS or held + size > EXTRACT_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from webtext.functions.extract import extract  # imported on the executor

    for batch in _page_slices(batches):
        cols = batch.to_pydict()
        urls, htmls = cols["url"], cols["html"]
        sels = cols.get("_selector") or [None] * len(urls)
        cts = cols.get("content_type") or [None] * len(urls)
        out = {f.name: [] for f in _ARROW_FIELDS}
        for url, markup, sel, ct in zip(urls, htmls, sels, cts):
            rec = extract(url or "", markup, sel, ct)
            out["title"].append(rec["title"])
            out["content"].append(rec["content"])
            out["links"].append(rec["links"])
            out["images"].append(rec["images"])
            out["metadata"].append(list(rec["metadata"].items()))
            out["matched_selector"].append(rec["matched_selector"])
            out["selector_used"].append(rec["selector_used"])
            out["extract_error"].append(rec["error"])
        arrays = [batch.column(name) for name in batch.schema.names if name != "html"]
        fields = [batch.schema.field(name) for name in batch.schema.names if name != "html"]
        for f in _ARROW_FIELDS:
            arrays.append(pa.array(out[f.name], type=f.type))
            fields.append(f)
        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def extract_pages(
    pages: DataFrame,
    keep: list[str] | None = None,
    selector: str | Column | None = None,
    spread: bool = False,
) -> DataFrame:
    """Parse every page once and return the page record.

    ``pages`` needs ``url`` and ``html`` (``content_type`` / ``status_code``
    optional); ``keep`` lists key columns to carry through. ``selector`` is a
    CSS selector for all rows, a column holding one per row, or None for the
    default main-content strategy. Parsing is CPU-bound per page: ``spread=True``
    spreads a scan with fewer splits than cores (never ask for it on a plan
    with a shuffle, whose partitions are spread already).
    """
    ship_package(pages.sparkSession)
    keep = [c for c in (keep or []) if c not in ("url", "html")]
    cols = [F.col(c) for c in keep] + [F.col("url"), F.col("html")]
    has_ct = "content_type" in pages.columns
    has_status = "status_code" in pages.columns
    if has_ct and "content_type" not in keep:
        cols.append(F.col("content_type"))
    if has_status and "status_code" not in keep:
        cols.append(F.col("status_code"))
    if selector is not None:
        sel = F.lit(selector) if isinstance(selector, str) else selector
        cols.append(sel.cast("string").alias("_selector"))
    src = pages.select(*cols)
    if spread:
        src = spread_scan(src)
    out_schema = T.StructType(
        [f for f in src.schema.fields if f.name != "html"] + list(PAGE_FIELDS.fields)
    )
    parsed = src.mapInArrow(_extract_batches, out_schema)
    content = F.col("content")
    clean = F.when(F.col("selector_used"), content).otherwise(clean_lines(content))
    status = F.col("status_code") if has_status else F.lit(None).cast("int")
    ctype = F.col("content_type") if has_ct else F.lit(None).cast("string")
    passthrough = [c for c in keep if c not in ("status_code", "content_type")]
    return parsed.select(
        *passthrough,
        "url",
        "title",
        "content",
        clean.alias("clean_text"),
        "links",
        "images",
        "metadata",
        status.alias("status_code"),
        ctype.alias("content_type"),
        "matched_selector",
        "extract_error",
    )


def page_stats(records: DataFrame) -> DataFrame:
    """Per page, link / image counts and clean-text bytes."""
    return records.select(
        *[c for c in records.columns if c in ("page_id", "url")],
        F.size("links").cast("long").alias("links_count"),
        F.size("images").cast("long").alias("images_count"),
        byte_length("clean_text").alias("content_bytes"),
    )


def scrape_error(url: Column, cause: Column) -> Column:
    """Error text of one failed page fetch."""
    return F.concat(F.lit("failed to scrape URL "), url, F.lit(": "), cause)


def snapshot_cause(found: Column, status: Column) -> Column:
    """Why a URL counts as failed in a snapshot: not stored, or a non-2xx status."""
    return (
        F.when(~found, F.lit("not in snapshot"))
        .when(status.isNotNull() & ((status < 200) | (status >= 300)), F.concat(F.lit("HTTP "), status.cast("string")))
    )


def _broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes (set as a number, or with a unit)."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]] if found else 0


def _records_of(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Page records of the wanted (url, _key, _sel), each extracted once.

    ``targets`` is narrow and written, so Spark knows its size: below the
    broadcast limit the snapshot is only scanned; above it a Bloom filter of
    the wanted keys ends all other rows at the scan, and only hits are shuffled.
    """
    spark = pages.sparkSession
    html = pages.select("url", "_key", "html", "status_code", "content_type")
    n = targets.count()
    if n * TARGET_BYTES > _broadcast_limit(spark):
        hits = wanted_rows(html, targets, ["url", "_key"], n).join(targets, ["url", "_key"])
    else:
        # parsing is CPU-bound and these hits are few: they go to all cores, not to the few tasks that found them
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        hits = html.join(targets, ["url", "_key"]).repartition(tasks, "url", "_sel")
    return extract_pages(hits, keep=["_key", "_sel"], selector=F.nullif(F.col("_sel"), F.lit("")))


def _with_records(requests: DataFrame, recs: DataFrame, on: list[str]) -> DataFrame:
    """Requests with their page records (left join on ``on``) and ``fetch_error`` (NULL on success)."""
    recs = recs.withColumn("_found", F.lit(True)).withColumnsRenamed({c: f"_r{c}" for c in [*on, "url", "_key"]})
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_r{c}"))
    joined = requests.join(recs, same, "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    cause = F.coalesce(snapshot_cause(found, F.col("status_code")), F.col("extract_error"))
    out = joined.withColumn("fetch_error", F.when(cause.isNotNull(), scrape_error(F.col("url"), cause)))
    # a failed fetch is a hole: the body of an error response is no page
    fields = ["title", "content", "clean_text", "links", "images", "metadata", "matched_selector"]
    out = out.withColumns({c: F.when(F.col("fetch_error").isNull(), F.col(c)) for c in fields})
    return out.drop("_found", "_sel", "_key", *[f"_r{c}" for c in [*on, "url", "_key"]])


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_key", F.col("page_id") if "page_id" in pages.columns else F.xxhash64("html"))


def scrape_urls(
    requests: DataFrame, pages: DataFrame, selector_col: str | None = None
) -> DataFrame:
    """Extract each distinct (url, selector) of ``requests`` once from the snapshot
    and join the record back to every request row (left join: an unknown URL
    keeps its row with NULL fields). Adds ``fetch_error`` (NULL on success).

    Of several responses of a URL the one of the largest page_id is taken. It
    is chosen on narrow columns; HTML is read for chosen rows only."""
    sel = F.coalesce(F.col(selector_col), F.lit("")) if selector_col else F.lit("")
    wanted = requests.select("url", sel.alias("_sel")).distinct()
    keyed = _keyed(pages)
    chosen = keyed.select("url", "_key").join(wanted.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.max("_key").alias("_key"))
    targets = written_table(chosen.join(wanted, "url").select("url", "_key", "_sel"), "wanted-pages")
    return _with_records(requests.withColumn("_sel", sel), _records_of(targets, keyed), ["url", "_sel"])


def scrape_urls_as_of(
    requests: DataFrame, responses: DataFrame, selector_col: str | None = None, time_col: str = "requested_at"
) -> DataFrame:
    """As :func:`scrape_urls`, each request at its own time ``time_col``: it gets the URL's latest
    response with ``fetched_at`` at or before it (of equal times the largest ``page_id``), given as ``fetched_at``.

    ``responses``: page_id, url, fetched_at, html[, status_code, content_type]. A request without a time,
    or before the first response, fails as not in the snapshot. Each distinct (response, selector) is extracted once.
    """
    sel = F.coalesce(F.col(selector_col), F.lit("")) if selector_col else F.lit("")
    keyed = _keyed(responses)
    narrow = keyed.select("url", "_key", "fetched_at")
    dated = asof_join(requests.withColumn("_sel", sel), narrow, ["url"], time_col, "fetched_at", ["_key", "fetched_at"], tie="_key")
    dated = written_table(dated, "dated-requests")
    targets = written_table(dated.where(F.col("_key").isNotNull()).select("url", "_key", "_sel").distinct(), "wanted-pages")
    return _with_records(dated.withColumn("_own", F.col("_key")), _records_of(targets, keyed).withColumn("_own", F.col("_key")), ["_own", "_sel"]).drop("_own")


def extract_batch(batches: DataFrame, pages: DataFrame, selector: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ordered URL batches -> (one row per input URL, one row per batch).

    Rows keep input position ``idx`` and duplicates; a failed URL has NULL page
    fields and ``error``. The batch row carries ``scraping errors: [...]`` in
    input order when any URL failed, else NULL. That string is one value per
    batch by definition; it collects only the batch's failures, so it is never
    larger than a small multiple of the batch's own ``urls`` value, which
    already sits in one input row.
    """
    items = batches.select("batch_id", F.posexplode("urls").alias("idx", "url"))
    if selector is not None:
        items = items.withColumn("selector", F.lit(selector))
    return _batch_rows(scrape_urls(items, pages, "selector" if selector is not None else None))


def extract_batch_as_of(items: DataFrame, responses: DataFrame, selector_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`extract_batch` for ``items`` (batch_id, idx, url, requested_at), each fetched as of its own time."""
    return _batch_rows(scrape_urls_as_of(items, responses, selector_col))


def _batch_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn(
        "error",
        F.when(F.col("fetch_error").isNotNull(), F.concat(F.lit("failed to scrape "), F.col("url"), F.lit(": "), F.col("fetch_error"))),
    )
    per_batch = rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.count("error").alias("n_errors"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("idx", "error")))).alias("_errs"),
    )
    summary = per_batch.select(
        "batch_id",
        "n_urls",
        "n_errors",
        F.when(
            F.col("n_errors") > 0,
            F.concat(F.lit("scraping errors: ["), F.array_join(F.transform("_errs", lambda e: e["error"]), " "), F.lit("]")),
        ).alias("batch_error"),
    )
    return rows, summary


def tool_response(rows: DataFrame) -> DataFrame:
    """P13 + P15: the page tool's answer for each scraped row.

    Success: two text parts (header with a 500-byte preview, then the raw clean
    text) and a structured map. Failure: one part ``Error scraping URL: ...``,
    ``is_error`` true, no structured map.
    """
    failed = F.col("fetch_error").isNotNull()
    header = F.concat(
        F.lit("Successfully scraped "), F.col("url"),
        F.lit("\n\nTitle: "), F.col("title"),
        F.lit("\n\nContent Preview:\n"), byte_prefix("clean_text", PREVIEW_BYTES), F.lit("..."),
    )
    ok_parts = F.array(header, F.concat(F.lit("RAW_CONTENT:\n"), F.col("clean_text")))
    err_parts = F.array(F.concat(F.lit("Error scraping URL: "), F.col("fetch_error")))
    structured = F.struct(
        F.col("url").alias("url"),
        F.col("title").alias("title"),
        F.col("clean_text").alias("content"),
        F.size("links").alias("links_count"),
        F.size("images").alias("images_count"),
        F.coalesce(F.col("status_code"), F.lit(0)).alias("status_code"),
        F.coalesce(F.col("content_type"), F.lit("")).alias("content_type"),
    )
    return rows.withColumns(
        {
            "parts": F.when(failed, err_parts).otherwise(ok_parts),
            "is_error": failed,
            "structured": F.when(~failed, structured),
        }
    )


def tool_response_full(rows: DataFrame) -> DataFrame:
    """Single-part variant with the whole clean text; structured = content, url."""
    failed = F.col("fetch_error").isNotNull()
    ok = F.concat(
        F.lit("Successfully scraped "), F.col("url"),
        F.lit("\n\nTitle: "), F.col("title"),
        F.lit("\n\nContent:\n"), F.col("clean_text"),
    )
    return rows.withColumns(
        {
            "parts": F.array(F.when(failed, F.concat(F.lit("Error scraping URL: "), F.col("fetch_error"))).otherwise(ok)),
            "is_error": failed,
            "structured": F.when(~failed, F.struct(F.col("clean_text").alias("content"), F.col("url").alias("url"))),
        }
    )
