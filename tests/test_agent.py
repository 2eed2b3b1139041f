"""Decisions, validation, sessions and post-processing (FIXTURES F6-F8, F10, F13)."""

import json

import pytest

from webtext.functions.decision import FALLBACK, decode_decision
from webtext.operators import agent as A
from webtext.operators import completers as C
from webtext.plans.answer import default_registry

VALID = {
    "message": "m",
    "tool_calls": [
        {"name": "scrape_url", "arguments": {"url": "https://x"}, "reasoning": "r"},
        {"name": "scrape_url", "arguments": {"url": "https://y", "selector": "p"}, "reasoning": "s"},
    ],
    "should_call": True,
    "confidence": 0.9,
    "explanation": "e",
    "post_process": "Summarize",
}


def dec(text):
    out = decode_decision(text)
    return None if out is None else json.loads(out)


def test_decode_valid_and_whitespace():
    d = dec(json.dumps(VALID))
    assert d["message"] == "m" and len(d["tool_calls"]) == 2 and d["should_call"] is True
    assert d["tool_calls"][1]["arguments"]["selector"] == {"kind": "string", "text": "p"}
    assert dec("  \n" + json.dumps(VALID) + " \t")["confidence"] == 0.9


@pytest.mark.parametrize(
    "text,field,value",
    [
        ('{"MESSAGE":"m","zzz":1}', "message", "m"),
        ('{"message":"m","message":"n"}', "message", "n"),
        ('{"message":"m","message":null}', "message", "m"),
        ("null", "message", ""),
        ('{"tool_calls":null}', "tool_calls", []),
        ('{"confidence":1}', "confidence", 1.0),
    ],
)
def test_decode_go_rules(text, field, value):
    assert dec(text.strip())[field] == value


@pytest.mark.parametrize(
    "text",
    [
        '{"message":"m"} xyz', '```json {"message":"m"} ```', "{'message':'m'}", '[{"message":"m"}]', "",
        '{"confidence":NaN}', '{"message":5}', '{"confidence":"0.9"}', '{"should_call":"true"}',
        '{"tool_calls":[{"arguments":[1]}]}', '{"confidence":1e400}',
    ],
)
def test_decode_fallback(text):
    assert dec(text) is None


def decisions_df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "request_id long, decision_text string")


def test_parse_route_confidence(spark):
    texts = [
        json.dumps(VALID),
        '{"message":"m"} xyz',
        json.dumps({**VALID, "confidence": 0.5}),
        json.dumps({**VALID, "confidence": 0.4999}),
        json.dumps({**VALID, "tool_calls": []}),
    ]
    d = A.route_decision(A.low_confidence(A.parse_decision(decisions_df(spark, texts))))
    r = {x.request_id: x for x in d.collect()}
    assert r[0].parse_ok and r[0].route == "tools" and r[0].confidence_note is None
    assert not r[1].parse_ok and r[1].decision.message == FALLBACK["message"] and r[1].decision.confidence == 0.1
    assert r[1].route == "explain" and r[1].decision.explanation == "Failed to parse agent decision"
    assert r[2].confidence_note is None
    assert r[3].confidence_note == "Confidence: 50.0% - I'm not very confident about this interpretation."
    assert r[4].route == "explain"
    calls = A.explode_calls(d).orderBy("request_id", "call_idx").collect()
    assert [(c.request_id, c.call_idx, c.n_calls) for c in calls][:2] == [(0, 1, 2), (0, 2, 2)]


def registry():
    reg = default_registry()
    reg.register(A.Tool("typed", "t", {"s": ("string", ""), "i": ("integer", ""), "n": ("number", ""),
                                       "b": ("boolean", ""), "o": ("object", "")}, ["s", "i"]))
    reg.register(A.Tool("bare", "b", None))
    reg.register(A.Tool("scrape_url", "duplicate, ignored", {"url": ("integer", "")}, []))
    return reg


CASES = [
    ("nope", {}, "unknown tool: nope"),
    ("scrape_url", {}, "missing required parameter 'url' for tool 'scrape_url'"),
    ("scrape_url", {"url": None}, "parameter 'url' must be a string"),
    ("scrape_url", {"url": 5}, "parameter 'url' must be a string"),
    ("scrape_url", {"url": "u", "extra": 1}, None),
    ("typed", {"i": 1}, "missing required parameter 's' for tool 'typed'"),
    ("typed", {"s": "x", "i": 1.5}, None),
    ("typed", {"s": "x", "i": "1"}, "parameter 'i' must be an integer"),
    ("typed", {"s": "x", "i": 1, "n": "z"}, "parameter 'n' must be a number"),
    ("typed", {"s": "x", "i": 1, "b": 1}, "parameter 'b' must be a boolean"),
    ("typed", {"s": "x", "i": 1, "o": 3}, None),
    ("typed", {"s": 1, "i": "x"}, "parameter 'i' must be an integer"),
    ("bare", {"a": 1}, None),
]


def test_validate_calls(spark):
    calls = [{"name": n, "arguments": a, "reasoning": ""} for n, a, _ in CASES]
    text = json.dumps({"message": "", "tool_calls": calls, "should_call": True, "confidence": 1})
    d = A.route_decision(A.parse_decision(decisions_df(spark, [text])))
    reg = registry()
    v = A.validate_calls(A.explode_calls(d), reg.catalog(spark)).orderBy("call_idx").collect()
    assert [x.validation_error for x in v] == [e for _, _, e in CASES]


def test_catalog_prompt_text():
    reg = default_registry()
    js = json.loads(reg.catalog_json())
    assert js[0]["name"] == "scrape_url" and js[0]["parameters"]["required"] == ["url"]
    assert A.system_prompt(A.ToolRegistry()).count("[]") == 1  # no tools -> []
    assert A.system_prompt(reg).endswith("- Set confidence based on how clear the user's intent is")


def test_tool_listing(spark):
    reg = registry()
    listing = A.tool_listing(A.catalog_with_pretty(reg, spark)).first().listing
    assert listing.startswith("Tools (3)\n- scrape_url: ")
    assert "- bare: b\n  Input schema: <none>" in listing


def test_session_turns(spark):
    rows = [(1, 0, "a"), (1, 1, "  "), (1, 2, " EXIT "), (1, 3, "b"), (2, 0, "quit"), (3, 0, "exit now"), (3, 1, "b"),
            (4, 0, "a"), (4, 1, " Quit")]
    got = A.session_turns(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    assert sorted((r.conv_id, r.turn, r.text) for r in got.collect()) == [(1, 0, "a"), (3, 0, "exit now"), (3, 1, "b"), (4, 0, "a")]


@pytest.mark.parametrize(
    "content,post,cfg,needs,final,max_tokens",
    [
        ("a \n\nb", "Summarize", 1000, True, "a b", 700),
        ("a", "Summarize", 0, True, "a", 700),
        ("a", "Summarize", 300, True, "a", 300),
        ("a", "", 1000, False, None, None),
        ("a", "  ", 1000, False, "a", None),
        ("", "Summarize", 1000, False, None, None),
    ],
)
def test_post_process(spark, content, post, cfg, needs, final, max_tokens):
    df = spark.createDataFrame([(1, "req", post, content)], "request_id long, user_text string, post_process string, content string")
    r = A.post_process(A.post_process_request(df, "m", cfg), C.lead_completer).first()
    assert r.needs_model == needs and r.final_output == final and r.post_max_tokens == max_tokens
    if needs:
        assert r.prompt == f"Instruction: {post.strip()}\n\nUser Request: req\n\nContent to process:\n{content}"


def test_aggregate_outputs(spark):
    rows = [(1, 1, " a "), (1, 2, "  "), (1, 3, "b"), (2, 1, "x")]
    out = {r.request_id: r.content for r in A.aggregate_outputs(spark.createDataFrame(rows, "request_id long, call_idx int, result string")).collect()}
    assert out == {1: "a \n\nb", 2: "x"}


def test_catalog_json_escapes():
    reg = A.ToolRegistry().register(A.Tool("t", "a<b>&c ", {"x": ("string", "")}, []))
    text = reg.catalog_json()
    assert "a\\u003cb\\u003e\\u0026c\\u2028" in text and json.loads(text)[0]["description"] == "a<b>&c "


def test_observed_agent_metrics(spark):
    from webtext.operators.metrics import observe_agent_metrics

    texts = [json.dumps(VALID), '{"message":"m"} xyz', json.dumps({**VALID, "confidence": 0.2})]
    decided = A.route_decision(A.parse_decision(decisions_df(spark, texts)))
    observed, obs = observe_agent_metrics(decided)
    assert observed.count() == 3
    assert obs.get == {"requests": 3, "calls": 4, "parse_failures": 1, "low_confidence": 2}
