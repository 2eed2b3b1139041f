"""extract_pages on Spark: record shape, clean text, batches and tool responses."""

from pyspark.sql import functions as F

from webtext.operators.pages import extract_batch, extract_pages, tool_response, tool_response_full

B = "https://e.org/d/p"
LONG = "L" * 120


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, status_code int, content_type string")


def test_record_and_clean_text(spark):
    html = f"<html><body><article>  {LONG}\n\n  tail  \n</article><a href='/x'>x</a></body></html>"
    df = pages_df(spark, [(1, B, html, 200, "text/html"), (2, B + "2", "<p>x", 200, "image/png")])
    r = {x.page_id: x for x in extract_pages(df, keep=["page_id"]).collect()}
    assert r[1].clean_text == f"{LONG}\ntail" and r[1].links == ["https://e.org/x"] and r[1].status_code == 200
    assert r[2].clean_text == "" and r[2].links == []


def test_partitions_do_not_change_rows(spark):
    rows = [(i, f"{B}/{i}", f"<article>{'w ' * 80}{i}</article><a href='/{i}'>", None, None) for i in range(40)]
    df = pages_df(spark, rows)
    one = sorted(tuple(r) for r in extract_pages(df.coalesce(1), keep=["page_id"]).select("page_id", "clean_text").collect())
    many = sorted(tuple(r) for r in extract_pages(df.repartition(7), keep=["page_id"]).select("page_id", "clean_text").collect())
    assert one == many


def test_extract_batch(spark):
    pages = pages_df(spark, [(1, "u1", f"<article>{LONG}</article>", None, None), (2, "u2", "<p>two</p>", None, None)])
    batches = spark.createDataFrame([(7, ["u1", "missing", "u1", "u2"]), (8, [])], "batch_id long, urls array<string>")
    rows, summary = extract_batch(batches, pages)
    got = sorted(rows.select("batch_id", "idx", "url", "clean_text", "error").collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == [0, 1, 2, 3]
    assert got[0].clean_text == got[2].clean_text == LONG
    assert got[1].clean_text is None
    assert got[1].error == "failed to scrape missing: failed to scrape URL missing: not in snapshot"
    s = {r.batch_id: r for r in summary.collect()}
    assert s[7].n_errors == 1 and s[7].batch_error == "scraping errors: [" + got[1].error + "]"
    assert 8 not in s  # an empty batch has no rows and no error


def test_tool_responses(spark):
    pages = pages_df(spark, [(1, "u1", "<title>T</title><article>" + "a" + "é" * 300 + "</article>", None, None)])
    batches = spark.createDataFrame([(1, ["u1", "nope"])], "batch_id long, urls array<string>")
    rows, _ = extract_batch(batches, pages)
    r = {x.idx: x for x in tool_response(rows).collect()}
    ok = r[0]
    assert ok.is_error is False and len(ok.parts) == 2
    assert ok.parts[0] == "Successfully scraped u1\n\nTitle: T\n\nContent Preview:\na" + "é" * 249 + "�..."
    assert ok.parts[1].startswith("RAW_CONTENT:\naé")
    assert ok.structured.links_count == 0 and ok.structured.content == "a" + "é" * 300
    bad = r[1]
    assert bad.is_error and bad.structured is None
    assert bad.parts == ["Error scraping URL: failed to scrape URL nope: not in snapshot"]
    full = {x.idx: x for x in tool_response_full(rows).collect()}
    assert full[0].parts[0].endswith("Content:\na" + "é" * 300)
    assert set(full[0].structured.asDict()) == {"content", "url"}


def test_selector_column(spark):
    df = pages_df(spark, [(1, "u", "<h1> A </h1><p>b</p>", None, None)]).withColumn("sel", F.lit("h1"))
    r = extract_pages(df, keep=["page_id"], selector=F.col("sel")).first()
    assert r.content == "A" and r.clean_text == "A"


def test_stored_status_and_content_type(spark):
    pages = pages_df(spark, [
        (1, "ok", f"<article>{LONG}</article>", 200, "text/html; charset=utf-8"),
        (2, "gone", f"<article>{LONG}</article>", 404, "text/html"),
        (3, "pdf", "%PDF-1.4", 200, "application/pdf"),
    ])
    batches = spark.createDataFrame([(1, ["ok", "gone", "pdf"])], "batch_id long, urls array<string>")
    rows, _ = extract_batch(batches, pages)
    r = {x.url: x for x in rows.collect()}
    assert r["ok"].error is None and r["ok"].clean_text == LONG and r["ok"].content_type.startswith("text/html")
    assert r["gone"].error == "failed to scrape gone: failed to scrape URL gone: HTTP 404"
    assert r["pdf"].error is None and r["pdf"].clean_text == "" and r["pdf"].links == []


def test_spread_scan_only_spreads_small_scans(spark, tmp_path):
    from webtext.sources.tables import spread_scan

    path = str(tmp_path / "t")
    spark.range(0, 1000, numPartitions=1).write.parquet(path)
    one = spark.read.parquet(path)
    assert one.rdd.getNumPartitions() == 1
    assert spread_scan(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = str(tmp_path / "m")
    spark.range(0, 1000, numPartitions=8).write.parquet(many)
    wide = spark.read.option("maxPartitionBytes", 1).parquet(many)
    if wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        assert spread_scan(wide) is wide


def test_worker_holds_few_pages_of_a_large_batch():
    """A batch of many pages goes out in slices bounded by rows and HTML bytes, every page once and in order."""
    import pyarrow as pa

    from webtext.operators.pages import EXTRACT_BYTES, EXTRACT_ROWS, _extract_batches

    big = "<title>b</title>" + "x" * (EXTRACT_BYTES // 2)
    htmls = [big if i % 100 < 3 else None if i % 7 == 0 else f"<title>t{i}</title>" for i in range(1000)]
    batch = pa.record_batch({"page_id": list(range(1000)), "url": [f"http://h/{i}" for i in range(1000)], "html": htmls})
    got = list(_extract_batches(iter([batch, batch.slice(0, 0)])))
    assert [i for b in got for i in b.column("page_id").to_pylist()] == list(range(1000))
    assert max(b.num_rows for b in got) <= EXTRACT_ROWS
    titles = [t for b in got for t in b.column("title").to_pylist()]
    assert titles == ["b" if h is big else "" if h is None else f"t{i}" for i, h in enumerate(htmls)]
    assert all(sum(len(htmls[i] or "") for i in b.column("page_id").to_pylist()) <= EXTRACT_BYTES for b in got if b.num_rows > 1)
