"""Extension points: a user batch completer (S4) and a registered tool (A13) run end to end."""

import json

from pyspark.sql import functions as F

from webtext.operators import agent as A
from webtext.operators import completers as C
from webtext.plans.answer import answer_requests, default_registry


def test_batch_completer(spark):
    def fake_model(pdf):
        if (pdf["prompt"] == "boom").any():
            raise RuntimeError("endpoint down")
        return pdf.assign(text=pdf["prompt"].str.upper(), error=None)

    req = spark.createDataFrame([(1, "hello world"), (2, "boom")], "request_id long, prompt string").repartition(2, "request_id")
    got = {r.request_id: r for r in C.complete(req, C.batch_completer(fake_model, "fake")).collect()}
    assert got[1].text == "HELLO WORLD" and got[1].model == "fake" and got[1].error is None
    assert got[1].prompt_tokens == 2 and got[1].completion_tokens == 2
    assert got[2].error == "failed to create chat completion: endpoint down" and got[2].text is None


def upper_tool(calls, ctx):
    text = A.arg_text("text")
    return calls.select("request_id", "call_idx", F.array(F.upper(text)).alias("parts"), F.lit(False).alias("is_error"))


def test_registered_tool_end_to_end(spark):
    reg = default_registry().register(A.Tool("shout", "upper-cases text", {"text": ("string", "input")}, ["text"], upper_tool))
    calls = [
        {"name": "shout", "arguments": {"text": "hi"}},
        {"name": "shout", "arguments": {"text": 3}},
        {"name": "shout", "arguments": {"text": "  "}},
        {"name": "shout", "arguments": {"text": "there"}},
    ]
    decision = json.dumps({"message": "m", "tool_calls": calls, "should_call": True, "confidence": 0.9,
                           "post_process": "Summarize"})
    req = spark.createDataFrame([(1, "please shout")], "request_id long, user_text string")
    dec = spark.createDataFrame([(1, decision)], "request_id long, decision_text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string, status_code int, content_type string")
    r = answer_requests(req, dec, reg, {"pages": pages}, C.lead_completer).first()
    assert (r.route, r.n_calls, r.n_rejected, r.n_succeeded, r.n_failed) == ("tools", 4, 1, 3, 0)
    assert r.tool_output == "HI\n\nTHERE"  # blank result dropped, call order kept
    assert r.final_output == "HI THERE" and r.post_error is None
