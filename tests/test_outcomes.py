"""Cases that the driver tables don't hold: repeated URLs, calls nobody runs, exact rounding, deep and large decisions."""

import pytest
from pyspark.sql import functions as F

from webtext.functions.decision import decode_decision
from webtext.functions.extract import is_html
from webtext.operators.agent import Tool, ToolRegistry, low_confidence, missing_params, param_types, run_calls
from webtext.operators.pages import scrape_urls
from webtext.session import checkpoint_dir


def test_one_response_per_url(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/x", "<title>old</title>", None, None), (2, "http://a/x", "<title>new</title>", None, None)],
        "page_id long, url string, html string, status_code int, content_type string")
    wanted = spark.createDataFrame([(0, "http://a/x"), (1, "http://a/x"), (2, "http://a/y")], "idx int, url string")
    got = {r.idx: (r.title, r.fetch_error) for r in scrape_urls(wanted, pages).collect()}
    assert got == {0: ("new", None), 1: ("new", None), 2: (None, "failed to scrape URL http://a/y: not in snapshot")}


def test_every_valid_call_has_an_outcome(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b")], "request_id long, call_idx int, name string")
    loses = Tool("b", "", None, [], lambda c, ctx: c.filter("request_id = 1").select("request_id", "call_idx", F.array(F.lit("ok")).alias("parts"), F.lit(False).alias("is_error")))
    for registry in (ToolRegistry().register(Tool("a", "", None)).register(loses), ToolRegistry().register(Tool("a", "", None))):
        got = {(r.request_id, r.call_idx): (r.is_error, r.result) for r in run_calls(calls, registry, {}).collect()}
        assert len(got) == 3 and got[(1, 1)] == (True, None) and got[(2, 1)] == (True, None)


def test_confidence_rounds_the_binary_value(spark):
    rows = [(c, "%.1f" % (c * 100)) for c in (0.1225, 0.2345, 0.3555, 0.3, 0.0005, 0.05, 0.4999)]
    d = spark.createDataFrame([((c,),) for c, _ in rows], "decision struct<confidence:double>")
    got = {r.decision.confidence: r.confidence_note for r in low_confidence(d).collect()}
    assert all(got[c].startswith(f"Confidence: {t}% - ") for c, t in rows)


def test_decisions_of_any_depth_and_number_range():
    deep = "[" * 3000 + "]" * 3000
    assert decode_decision('{"message":"m","other":' + deep + "}") is not None
    big = "1" + "0" * 400
    assert decode_decision('{"tool_calls":[{"name":"t","arguments":{"n":' + big + "}}]}") is None
    assert decode_decision('{"other":[{"n":' + big + "}]}") is None


def test_both_faults_of_a_call_are_seen(spark):
    registry = ToolRegistry().register(Tool("t", "", {"a": ("string", ""), "b": ("integer", "")}, ["a"]))
    calls = spark.createDataFrame([(1, 1, "t", {"b": ("string", "x")})], "request_id long, call_idx int, name string, arguments map<string,struct<kind:string,text:string>>")
    assert missing_params(calls, registry.catalog(spark)).first().validation_error == "missing required parameter 'a' for tool 't'"
    assert param_types(calls, registry.catalog(spark)).first().validation_error == "parameter 'b' must be an integer"


def test_only_html_is_parsed():
    assert is_html("text/html; charset=utf-8") and is_html("application/xhtml+xml") and is_html(None)
    assert not is_html("application/rss+xml") and not is_html("text/xml")


def test_checkpoints_need_shared_storage():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_failed_decisions_are_errors(spark):
    """No answer, an empty answer and a transport error are errors, not the fallback; a bad answer is the fallback."""
    from webtext.plans.answer import decide

    req = spark.createDataFrame([(i, f"u{i}") for i in range(5)], "request_id long, user_text string")
    answers = spark.createDataFrame(
        [(0, 1, '{"message":"m"}', None), (1, 1, "not json", None), (2, 0, None, None), (3, 1, None, "boom")],
        "request_id long, n_choices int, content string, error string")
    answers = answers.selectExpr("*", "null AS model", "0 AS prompt_tokens", "0 AS completion_tokens", "0 AS total_tokens")
    got = {r.request_id: (r.error, r.parse_ok, r.route) for r in decide(req, answers).collect()}
    assert got == {
        0: (None, True, "explain"), 1: (None, False, "explain"),
        2: ("agent processing failed: no response choices returned", None, None),
        3: ("agent processing failed: failed to create chat completion: boom", None, None),
        4: ("agent processing failed: no completion", None, None)}
    texts = spark.createDataFrame([(0, '{"message":"m"}'), (1, None)], "request_id long, decision_text string")
    got = {r.request_id: r.error for r in decide(req.where("request_id < 2"), texts).collect()}
    assert got == {0: None, 1: "agent processing failed: no response choices returned"}


def test_document_tool(spark):
    from webtext.plans.answer import read_document_handler

    docs = spark.createDataFrame([(1, "one", "s", 3), (1, "longer", "s", 6), (2, None, None, 0)], "doc_id long, text string, source string, n_chars long")
    rows = [(1, {"doc_id": ("number", "1"), "with_source": ("boolean", "true")}), (2, {"doc_id": ("number", "1"), "min_chars": ("number", "6.5")}),
            (3, {"doc_id": ("number", "2")}), (4, {"doc_id": ("number", "1.5")}), (5, {"doc_id": ("number", "9")})]
    calls = spark.createDataFrame([(i, 1, a) for i, a in rows], "request_id long, call_idx int, arguments map<string,struct<kind:string,text:string>>")
    got = {r.request_id: (r.parts, r.is_error) for r in read_document_handler(calls, {"documents": docs}).collect()}
    none = (["Error reading document: no such document"], True)
    assert got == {1: (["Document 1 from s", "longer"], False), 2: (["Error reading document: document too short"], True), 3: (["Document 2", ""], False), 4: none, 5: none}


def test_terms_outside_an_external_corpus_count(spark):
    from webtext.operators.completers import term_weights

    schema = "request_id long, content string"
    own, corpus = spark.createDataFrame([(1, "red fox")], schema), spark.createDataFrame([(7, "red"), (8, "red")], schema)
    assert {r.term: r.weight for r in term_weights(own, corpus).collect()} == {"red": 500000, "fox": 1000000}


def test_request_keys_of_any_ids(spark):
    """Keys of the largest ids and turns are distinct, and answers derived from them are joined by key."""
    from webtext.operators.completers import replay_completer
    from webtext.plans.answer import answer_requests, library_registry
    from webtext.sources import derived as D

    lines = [(c, t, "user", f"{c} {t}") for c in (0, 3_000_000_000, 2**63 - 1, -(2**63), -1) for t in (0, 1, 2**32, 2**62)]
    req = D.user_requests(spark.createDataFrame(lines, "conv_id long, turn long, role string, text string")).drop("conv_id", "turn")
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<title>t{i}</title>") for i in range(7)], "page_id long, url string, html string").selectExpr("*", "200 status_code", "'text/html' content_type")
    docs = spark.createDataFrame([(i, f"d{i}", "s", 2) for i in range(7)], "doc_id long, text string, source string, n_chars long")
    got = answer_requests(req, D.decisions(req, pages), library_registry(), {"pages": pages, "documents": docs}, replay_completer(D.post_completions(req))).collect()
    assert {r.request_id for r in got} == {f"{c}:{t}" for c, t, *_ in lines} and len(got) == 20
    assert any(r.tool_output for r in got) and any(r.error for r in got)
