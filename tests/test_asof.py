"""As-of join and keyed lookup against plain Python; the plan of the lookup."""

import random
import re

import pytest
from pyspark.sql import functions as F

from webtext.operators import lookup
from webtext.operators import pages as P
from webtext.operators.asof import asof_join


def latest(rights, key, time):
    found = [r for r in rights if r[0] == key and None not in (r[0], r[1], time) and r[1] <= time]
    return max(found, key=lambda r: (r[1], r[2]))[2:] if found else (None, None)


@pytest.mark.parametrize("ranges", [1, 7])
def test_asof_join(spark, ranges):
    rng = random.Random(3)
    keys = ["hot"] * 5 + ["a", "b", None]  # most rows have one key
    rights = [(rng.choice(keys), rng.choice([None, *range(40)]), i, f"p{i}") for i in range(300)]
    lefts = [(i, rng.choice([*keys, "none"]), rng.choice([None, *range(-2, 45)])) for i in range(400)]
    lefts += lefts[:5]  # repeated rows
    left = spark.createDataFrame(lefts, "id int, key string, at int").repartition(3)
    right = spark.createDataFrame(rights, "key string, since int, n int, payload string")
    got = asof_join(left, right, ["key"], "at", "since", ["payload", "n"], tie="n", ranges=ranges)
    assert got.columns == ["id", "key", "at", "payload", "n"]
    want = sorted(((*r, *reversed(latest([(k, t, n, p) for k, t, n, p in rights], r[1], r[2]))) for r in lefts), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert asof_join(left.limit(0), right, ["key"], "at", "since", ["n"]).count() == 0
    assert asof_join(left, right.limit(0), ["key"], "at", "since", ["n"]).where("n is null").count() == len(lefts)


def test_asof_join_of_two_keys_carries_over_ranges(spark):
    """One right row, far before its left rows, reaches all of them in every range."""
    left = spark.range(2000).select(F.lit("u").alias("a"), F.lit(1).alias("b"), (F.col("id") + 100).alias("t"))
    right = spark.createDataFrame([("u", 1, 5, "x"), ("u", 2, 6, "y")], "a string, b int, s long, v string")
    got = asof_join(left, right, ["a", "b"], "t", "s", ["v"], ranges=16)
    assert got.groupBy("v").count().collect() == [("x", 2000)]


def test_bloom_filter_keeps_all_wanted_and_few_others(spark):
    table = spark.range(20000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), "id")
    keys = table.where("id % 40 = 0").select("url", "id").unionByName(spark.createDataFrame([(None, None)], "url string, id long"))
    kept = {r.id for r in lookup.wanted_rows(table, keys, ["url", "id"]).collect()}
    wanted = set(range(0, 20000, 40))
    assert wanted <= kept and len(kept - wanted) < 100
    assert lookup.wanted_rows(table, keys.limit(0), ["url"]).count() == 0


def _pages(spark):
    rows = [(i, f"http://h/{i}", f"<title>t{i}</title><body>{'x' * i}</body>") for i in range(300)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "cast(null as int) status_code", "cast(null as string) content_type")


def test_lookup_without_broadcasts_shuffles_hits_only(spark, tmp_path):
    _pages(spark).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    requests = spark.createDataFrame([(1, "http://h/7"), (2, "http://h/7"), (3, "http://h/250"), (4, "http://none/")], "id int, url string")
    want = {1: "t7", 2: "t7", 3: "t250", 4: None}
    assert {r.id: r.title for r in P.scrape_urls(requests, pages).collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = P.scrape_urls(requests, pages)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {r.id: r.title for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # between the scan that reads html and its first exchange stands the filter on the wanted keys
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "html" in x)
    above = []
    for x in reversed(lines[:scan]):
        if "Exchange" in x:
            break
        above.append(x)
    assert any("Filter" in x and "subquery" in x for x in above), plan
    assert len(re.findall(r"FileScan[^\n]*html", plan)) == 1


def test_as_of_fetch_of_repeated_and_undated_requests(spark):
    rows = [(1, "u", 10, "one", 200), (2, "u", 20, "two", 500), (3, "u", 30, "three", 200), (4, "u", 30, "four", 200)]
    responses = spark.createDataFrame(rows, "page_id long, url string, fetched_at long, name string, status_code int").selectExpr(
        "page_id", "url", "fetched_at", "concat('<title>', name, '</title>') html", "status_code", "cast(null as string) content_type")
    asked = [(1, "u", 5), (2, "u", 10), (3, "u", 19), (4, "u", 25), (5, "u", 30), (6, "u", 99), (7, "u", None), (8, None, 50), (6, "u", 99)]
    got = P.scrape_urls_as_of(spark.createDataFrame(asked, "id int, url string, requested_at long"), responses).collect()
    title = {r.id: (r.title, r.fetched_at, r.fetch_error) for r in got}
    missing = "failed to scrape URL u: not in snapshot"
    assert len(got) == len(asked)
    assert title[1] == (None, None, missing) and title[2] == ("one", 10, None) == title[3]
    assert title[4] == (None, 20, "failed to scrape URL u: HTTP 500")
    assert title[5] == title[6] == ("four", 30, None) and title[7] == (None, None, missing) and title[8][0] is None
