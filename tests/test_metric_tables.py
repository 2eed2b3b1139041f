"""Sketches, rollups, snapshot differences, salted keyword joins, table function tools and windowed metrics."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtext.operators import agent as A
from webtext.operators import completers as C
from webtext.operators import metrics as M
from webtext.operators import sketches as K
from webtext.operators.snapshots import snapshot_difference
from webtext.operators.table_tools import table_tool, typed_arguments
from webtext.streaming.streams import file_stream, late_rows, write_epochs
from webtext.streaming.windows import host_windows, latest_windows, line_sessions, summary_windows


def test_sketch_errors_and_merges(spark):
    """200,000 rows of 50,000 URLs in 40 groups: merging the groups equals one sketch of all rows, within the stated errors."""
    rows = spark.range(200000).select((F.col("id") % 40).alias("g"), F.concat(F.lit("u"), F.col("id") % 50000).alias("url"), F.pmod(F.xxhash64("id"), F.lit(1000003)).alias("size"))
    stored = K.stored_sketches(rows, {"g": F.col("g")}, F.col("url"), F.col("size"), total=F.col("size"))
    merged = K.merged_sketches(K.merged_sketches(stored.withColumn("half", F.col("g") % 2), ["half"], ["total"]), [], ["total"])
    direct = K.stored_sketches(rows, {"g": F.lit(1)}, F.col("url"), F.col("size"), total=F.col("size"))
    sizes = sorted(r.size for r in rows.select("size").collect())
    for s in (merged, direct):
        got = s.select("rows", "total", K.distinct_count().alias("urls"), *[K.size_quantile(q).alias(f"q{int(q * 100)}") for q in (0.01, 0.5, 0.99)]).first()
        assert got.rows == 200000 and got.total == sum(sizes)
        assert abs(got.urls - 50000) < 4 * 0.0082 * 50000
        for q in (0.01, 0.5, 0.99):
            assert sizes[int((q - 0.004) * 200000)] <= got[f"q{int(q * 100)}"] <= sizes[min(199999, int((q + 0.004) * 200000))]
    exact = K.stored_sketches(rows.where("id < 300"), {"g": F.lit(1)}, F.col("url"), F.col("size")).select(K.distinct_count(), K.size_quantile(0.5)).first()
    assert tuple(exact) == (300, statistics.median_low(r.size for r in rows.where("id < 300").collect()))


def test_sketches_of_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", "u", 3), (None, None, None)], "k string, url string, size long")
    stored = K.stored_sketches(rows, {"k": F.col("k")}, F.col("url"), F.col("size"))
    got = {r.k: (r.rows, r.urls, r.p) for r in stored.select("k", "rows", K.distinct_count().alias("urls"), K.size_quantile(0.5).alias("p")).collect()}
    assert got == {"a": (2, 1, 3), None: (1, 0, None)}
    assert K.merged_sketches(stored.limit(0), ["k"]).count() == 0


def test_rollup_tells_null_keys_from_levels(spark):
    rows = spark.createDataFrame(
        [("http://A.b.com/x", 200, "abc", ["l"], None), ("http://a.b.com/x", None, None, None, "e"), ("http://com/", 200, "é", [], None), (None, None, None, None, "e")],
        "url string, status_code int, clean_text string, links array<string>, error string")
    got = {(r.level_id, r.tld, r.domain, r.host, r.status_code): (r.pages, r.urls, r.bytes, r.failures) for r in M.extract_rollup(rows).collect()}
    assert got[(15, None, None, None, None)] == (4, 3, 5, 2)
    assert got[(7, "com", None, None, None)] == (3, 3, 5, 1) and got[(3, "com", "b.com", None, None)] == (2, 2, 3, 1)
    assert got[(1, "com", "b.com", "a.b.com", None)] == (2, 2, 3, 1) and got[(0, "com", "b.com", "a.b.com", None)] == (1, 1, None, 1)
    assert got[(0, None, None, None, None)] == (1, 0, None, 1) == got[(7, None, None, None, None)]


def test_snapshot_difference_is_bag_difference(spark):
    rng = random.Random(2)
    old, new = ([(rng.choice(["u", "v", "w", None]), rng.choice(["a", "b", None])) for _ in range(n)] for n in (40, 30))
    old += [("hot", "same")] * 500
    new += [("hot", "same")] * 700 + [("x", "only")]
    got = snapshot_difference(spark.createDataFrame(old, "url string, html string"), spark.createDataFrame(new, "url string, html string")).collect()
    a, b = Counter(old), Counter(new)
    assert len(got) == len(a.keys() | b.keys())
    assert sum(r.n_added for r in got) == sum((b - a).values()) and sum(r.n_removed for r in got) == sum((a - b).values()) and sum(r.n_repeated for r in got) == sum((a & b).values())
    added, removed = {u for u, _ in b - a}, {u for u, _ in a - b}
    for r in got:
        assert r.change in (("changed",) if (r.n_added or r.n_removed) and r.url in added & removed else ("added",) if r.n_added else ("removed",) if r.n_removed else ("repeated",))
    assert snapshot_difference(spark.createDataFrame([], "url string, html string"), spark.createDataFrame([], "url string, html string")).count() == 0


def test_hot_terms_are_salted(spark):
    """One term in half of all texts: same keywords, and its rows lie in as many parts as there are salts."""
    rows = [(i, ("hot " if i % 2 else "") + f"w{i % 97} t{i} t{i} end") for i in range(2000)] + [(5000, None), (5001, "")]
    req = spark.createDataFrame(rows, "request_id long, content string")
    hot = C.hot_terms(req, share=0.1)
    assert set(hot) == {"hot", "end"}
    def plain(df):
        return sorted(tuple(r) for r in df.select("request_id", "rank", "term", "weight").collect())

    assert plain(C.top_keywords(req, hot=hot)) == plain(C.top_keywords(req)) == plain(C.top_keywords(req, hot=[]))
    tf = C._term_counts(req.select("request_id", F.split("content", " ").alias("terms")))
    salted = tf.where("term = 'hot'").groupBy(F.pmod(F.xxhash64("request_id"), F.lit(64))).count()
    assert salted.count() == 64 and salted.agg(F.max("count")).first()[0] < 40


def test_table_function_tool(spark):
    def repeat(text, times, loud):
        for i in range(times or 0):
            yield (i, (text or "").upper() if loud else text)

    tool = table_tool("repeat", "", {"text": ("string", ""), "times": ("integer", ""), "loud": ("boolean", "")}, ["text"], {"n": T.IntegerType(), "said": T.StringType()}, repeat)
    registry = A.ToolRegistry().register(tool)
    entry = {"text": ("string", "a"), "times": ("number", "3")}
    rows = [(1, 1, "repeat", entry), (1, 2, "repeat", {**entry, "loud": ("boolean", "true")}), (2, 1, "repeat", {"text": ("string", "b")}), (2, 2, "other", {}), (3, 1, "repeat", {"times": ("number", "1")})]
    calls = spark.createDataFrame(rows, "request_id long, call_idx int, name string, arguments map<string,struct<kind:string,text:string>>")
    checked = A.validate_calls(calls, registry.catalog(spark))
    valid = checked.where("validation_error is null")
    got = {(r.request_id, r.call_idx): (r.result, r.is_error) for r in A.run_calls(valid, registry, {}).collect()}
    assert got == {(1, 1): ("0: a\n1: a\n2: a", False), (1, 2): ("0: A\n1: A\n2: A", False), (2, 1): ("", False)}
    made = tool.rows_of(valid)
    assert made.columns == ["request_id", "call_idx", "row_idx", "n", "said"] and made.schema["n"].dataType == T.IntegerType() and made.count() == 6


def test_typed_arguments():
    given = {"a": {"kind": "number", "text": "2.0"}, "b": {"kind": "boolean", "text": "false"}, "c": {"kind": "null", "text": None}}
    assert typed_arguments(given, {"a": "integer", "b": "boolean", "c": "string", "d": "number"}) == {"a": 2, "b": False, "c": None, "d": None}
    assert typed_arguments(None, {"a": "string"}) == {"a": None}


def _feed(spark, path, rows, schema):
    df = spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def _run(spark, tmp, batches, schema, windows, mode):
    late = 0
    for rows in batches:
        s = _feed(spark, f"{tmp}/in", rows, schema)
        stream = windows(file_stream(spark, f"{tmp}/in", s))
        q = write_epochs(stream, lambda b, e: b, f"{tmp}/out", f"{tmp}/ckpt", mode)
        q.awaitTermination()
        late += late_rows(q)
    return spark.read.schema(stream.schema.add("epoch_id", "long")).parquet(f"{tmp}/out"), late


@pytest.mark.parametrize("kind", ["host", "summary"])
def test_tumbling_windows_drop_and_count_late_rows(spark, tmp_path, kind):
    one = [("2024-01-01 10:00:00", 1), ("2024-01-01 11:00:00", 2), ("2024-01-05 00:00:00", 4)]
    two = [("2024-01-04 12:00:00", 8), ("2024-01-01 12:00:00", 16), ("2024-01-01 13:00:00", 32)]  # the last two come after the watermark
    if kind == "host":
        schema = "at string, n int, url string, clean_text string, links array<string>, images array<string>, status_code int, extract_error string"
        rows = [[(t, n, "http://h/", "x" * n, ["l"], [], None, None) for t, n in part] for part in (one, two)]
        versions, late = _run(spark, tmp_path, rows, schema, lambda s: host_windows(s, "at", delay="1 day"), "update")
        got = latest_windows(versions, ["window_start", "window_end", "host", "status_code"])
        sums = {r.window_start.day: (r.pages, r.bytes, r.links) for r in got.collect()}
        assert sums == {1: (2, 3, 2), 5: (1, 4, 1), 4: (1, 8, 1)}
    else:
        schema = "at string, n long, style string, original_size long, summary_size long, tokens_used long, error string"
        rows = [[(t, n, "s", n, n, n, None) for t, n in part] for part in (one, two)]
        versions, late = _run(spark, tmp_path, rows, schema, lambda s: summary_windows(s, "at", delay="1 day"), "update")
        got = latest_windows(versions, ["window_start", "window_end", "style"])
        assert {r.window_start.day: (r.rows, r.bytes_in) for r in got.collect()} == {1: (2, 3), 5: (1, 4), 4: (1, 8)}
    assert late > 0  # rows that share a window are counted after their partial aggregation


def test_session_windows_join_over_micro_batches(spark, tmp_path):
    t = "2024-01-01 {:02d}:{:02d}:00"
    one = [(1, "a b", t.format(0, 0)), (1, "c", t.format(0, 18)), (2, "d", t.format(0, 0))]
    two = [(1, "e f g", t.format(0, 9)), (2, "h", t.format(0, 10)), (2, "i", t.format(0, 21))]  # joins two sessions; the gap itself is no parting
    end = [(9, "beat", "2024-02-01 00:00:00")]
    closed, late = _run(spark, tmp_path, [one, two, end], "conv_id long, text string, at string", lambda s: line_sessions(s, "at", "10 minutes", "1 day"), "append")
    got = sorted((r.conv_id, r.window_start.minute, r.window_end.minute, r.lines, r.words) for r in closed.collect())
    assert late == 0 and got == [(1, 0, 28, 3, 6), (2, 0, 20, 2, 2), (2, 21, 31, 1, 1)]
