"""Property tests: Spark text expressions vs direct Python statements of the same rules."""

from hypothesis import given, settings
from hypothesis import strategies as st

from webtext.functions.text import WS_CHARS, byte_prefix, clean_lines, py_trim, word_count

ALPHABET = st.sampled_from(list(WS_CHARS) + list("ab é中\x1c​,."))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=40)


def py_clean(s: str) -> str:
    return "\n".join(x for x in (py_trim(line) for line in s.split("\n")) if x)


def py_words(s: str) -> int:
    n, inside = 0, False
    for ch in s:
        if ch in WS_CHARS:
            inside = False
        elif not inside:
            n, inside = n + 1, True
    return n


def py_prefix(s: str, n: int) -> str:
    b = s.encode("utf-8")
    if len(b) <= n:
        return s
    head = b[:n]
    whole = head.decode("utf-8", "ignore")
    return whole + "�" * (n - len(whole.encode("utf-8")))


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_text_expressions_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = df.select("i", clean_lines("s").alias("c"), word_count("s").alias("w"), byte_prefix("s", 7).alias("p")).collect()
    for r in got:
        s = texts[r.i]
        assert r.c == py_clean(s)
        assert r.w == py_words(s)
        assert r.p == py_prefix(s, 7)
        assert py_clean(r.c) == r.c  # idempotent


json_scalars = st.one_of(st.none(), st.booleans(), st.integers(-10**6, 10**6), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=5))
args = st.dictionaries(st.text(min_size=1, max_size=4), json_scalars, max_size=4)
calls = st.lists(st.fixed_dictionaries({"name": st.text(max_size=6), "arguments": args, "reasoning": st.text(max_size=6)}), max_size=3)
decisions = st.fixed_dictionaries({
    "message": st.text(max_size=8), "tool_calls": calls, "should_call": st.booleans(),
    "confidence": st.floats(0, 1), "explanation": st.text(max_size=8), "post_process": st.text(max_size=8),
})


@settings(max_examples=200, deadline=None)
@given(decisions)
def test_decoder_round_trip(d):
    import json

    from webtext.functions.decision import decode_decision

    out = json.loads(decode_decision(json.dumps(d)))
    assert out["message"] == d["message"] and out["should_call"] == d["should_call"]
    assert out["confidence"] == float(d["confidence"]) and len(out["tool_calls"]) == len(d["tool_calls"])
    for got, want in zip(out["tool_calls"], d["tool_calls"]):
        assert got["name"] == want["name"] and set(got["arguments"]) == set(want["arguments"])
        for k, v in want["arguments"].items():
            kind = got["arguments"][k]["kind"]
            expected = ("null" if v is None else "boolean" if isinstance(v, bool) else
                        "number" if isinstance(v, (int, float)) else "string")
            assert kind == expected


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_decoder_never_raises(text):
    from webtext.functions.decision import decode_decision

    out = decode_decision(text)
    assert out is None or out.startswith("{")
