"""Summaries and keywords (FIXTURES F3, F5, F9) and the offline completers."""

from pyspark.sql import functions as F

from webtext.operators import completers as C
from webtext.operators import summarize as S

REQ = "request_id long, content string, max_length int, style string, language string"


def test_prompts(spark):
    rows = [(1, "X", 0, "", ""), (2, "X", -1, "haiku", "French"), (3, "X", 50, "bullet_points", ""), (4, "X", 5, "detailed", "German")]
    got = {r.request_id: r.prompt for r in S.summary_prompt(spark.createDataFrame(rows, REQ)).collect()}
    assert got[1] == ("Please summarize the following text in approximately 200 words or less. Provide a concise "
                      "summary focusing on the most important information:\n\nX")
    assert got[2] == "Please summarize the following text. Provide a clear and informative summary in French:\n\nX"
    assert got[3] == ("Please summarize the following text in approximately 50 words or less. Format the summary as "
                      "bullet points, highlighting the key information:\n\nX")
    assert got[4] == ("Please summarize the following text in approximately 5 words or less. Provide a detailed summary "
                      "that captures the main points, key arguments, and important details in German:\n\nX")


def completions(spark):
    rows = [
        (1, "summary", 1, "  é summary  ", "m", 3, 4, 7, None),
        (2, "summary", 0, None, "m", 0, 0, 0, None),
        (3, "summary", 1, None, "m", 0, 0, 0, "boom"),
        (1, "keywords", 1, " a, b c,, d ", "m", 1, 1, 2, None),
        (2, "keywords", 1, "a,a", "m", 1, 1, 2, None),
        (4, "keywords", 1, ",", "m", 1, 1, 2, None),
    ]
    return spark.createDataFrame(
        rows, "request_id long, kind string, n_choices int, content string, model string, "
        "prompt_tokens int, completion_tokens int, total_tokens int, error string")


def test_replay_and_response(spark):
    req = spark.createDataFrame([(i, "éé text", 0, "", "") for i in (1, 2, 3, 4)], REQ)
    comp = C.complete(req, C.replay_completer(completions(spark), "summary"))
    resp = {r.request_id: r for r in S.summary_response(req, comp).collect()}
    assert resp[1].summary == "é summary" and resp[1].summary_size == 10 and resp[1].original_size == 9
    assert resp[1].metadata == {"style": "concise", "language": "", "prompt_tokens": "3", "completion_tokens": "4"}
    assert resp[1].tokens_used == 7 and resp[1].error is None
    assert resp[2].error == "no response choices returned" and resp[2].summary is None
    assert resp[3].error == "failed to create chat completion: boom"
    assert resp[4].error == "no completion"
    kw = C.complete(req, C.replay_completer(completions(spark), "keywords"))
    both = {r.request_id: r for r in S.summary_with_keywords(S.summary_response(req, comp), kw).collect()}
    assert both[1].keywords == ["a", "b c", "d"]
    assert both[2].keywords is None  # the summary failed, so the row failed
    parsed = {r.request_id: r.k for r in kw.select("request_id", S.parse_keywords(F.col("text")).alias("k")).collect()}
    assert parsed[2] == ["a", "a"] and parsed[4] == []


def test_lead_completer(spark):
    req = spark.createDataFrame([(1, " a b c  d ", 2, "", ""), (2, "a b c", -1, "", "")], REQ)
    got = {r.request_id: r.text for r in C.complete(req, C.lead_completer).collect()}
    assert got == {1: "a b", 2: "a b c"}


def test_extractive_and_keywords(spark):
    docs = [
        (1, "Cats purr. Dogs bark loudly at cats. Birds sing.", 4, "concise", ""),
        (2, "Dogs bark. Dogs run.", 1, "bullet_points", ""),
        (3, "", 10, "", ""),
    ]
    req = spark.createDataFrame(docs, REQ)
    got = {r.request_id: r.text for r in C.complete(req, C.extractive_completer()).collect()}
    # brute force: weights tf*1e6 div df with df over the three texts
    assert got[3] == ""
    assert got[2].startswith("- ")
    assert got[1] in ("Dogs bark loudly at cats.", "Cats purr. Birds sing.", "Cats purr.", "Birds sing.")
    top = C.top_keywords(req).filter("request_id = 1").orderBy("rank").collect()
    assert top[0].term == "cats" and len(top) <= 10  # tf 2, df 1 -> highest weight


def odd_requests(spark):
    """Requests that share an id or have none, null and empty texts, sentences without terms."""
    rows = [(i % 23 if i % 5 else 100 + i, " ".join(f"w{(i * k) % 19} Und{k % 3} t{i}" + ".!\n"[k % 3] for k in range(i % 9)) + (" --- . !" if i % 4 == 0 else ""), i % 3 * 4, "concise", "") for i in range(90)]
    rows += [(None, "lost red fox. red end", 3, "concise", ""), (None, "lost end", 0, "concise", ""), (900, None, 5, "concise", ""), (901, "", 5, "", ""), (902, "?! -- .", 5, "", "")]
    return rows, spark.createDataFrame(rows, REQ).repartition(5)


def term_tables(rows):
    import re
    from collections import Counter

    tf = Counter((r[0], t) for r in rows for t in re.findall(r"[^\W_]+", (r[1] or "").lower()))
    return tf, Counter(t for _, t in tf)


def test_keywords_by_any_way_of_their_terms(spark):
    """Same keywords whether terms are weighted in place or shuffled, salted or not; brute force."""
    rows, req = odd_requests(spark)
    tf, df = term_tables(rows)
    want = {}
    for (r, t), n in tf.items():
        want.setdefault(r, []).append((-(n * 1000000 // df[t]), t))
    want = {(r, k + 1, t, -w) for r, ws in want.items() for k, (w, t) in enumerate(sorted(ws)[:10])}
    for hot in (None, [], ["und0", "w0", "t3"]):
        for frequent in (0, 6, C.FREQUENT):
            got = [tuple(x) for x in C.top_keywords(req, hot=hot, frequent=frequent).select("request_id", "rank", "term", "weight").collect()]
            assert len(got) == len(want) and set(got) == want


def test_frequent_terms_are_not_shuffled(spark):
    """Only the rows of seldom terms are shuffled by term; texts of their own are counted in place."""
    rows = [(i, " ".join(f"w{k}" for k in range(50)) + f" own{i}", 10, "", "") for i in range(200)]
    req = spark.createDataFrame(rows, REQ)
    here, shuffled = C._weight_parts(req, frequent=60)
    assert here.count() == 200 * 50 and shuffled.count() == 200
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan
    assert C._leading(here, 3).count() < 200 * 5


def test_extractive_by_any_way_of_its_terms(spark):
    rows, req = odd_requests(spark)
    want = None
    for frequent in (C.FREQUENT, 0, 6):
        got = sorted((x.request_id, x.summary_text) for x in C.extractive_summaries(req, frequent=frequent).collect())
        want = want or got
        assert got == want and len({r for r, _ in got}) > 30
    # the whole table in one corpus gives the same weights as none where ids are keys
    keyed = req.where("request_id >= 100 and request_id < 900")
    assert sorted(map(tuple, C.extractive_summaries(keyed, keyed).collect())) == sorted(map(tuple, C.extractive_summaries(keyed).collect()))
