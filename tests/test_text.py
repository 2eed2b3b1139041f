"""P9, S9 and the byte cut (FIXTURES F2, F4, F12)."""

import pytest
from pyspark.sql import functions as F

from webtext.functions.text import byte_prefix, clean_lines, py_trim, validate_content, word_count, ws_trim


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "inp,expected",
    [
        ("  a \n\n\tb \n", "a\nb"),
        ("a  b", "a  b"),
        ("a b", "a b"),
        (" \n \t", ""),
        ("a\r\nb", "a\nb"),
        ("x​", "x​"),
    ],
)
def test_clean_lines(spark, inp, expected):
    assert one(spark, inp, clean_lines) == expected


def test_clean_lines_idempotent(spark):
    s = " a \n\n b 　\n\tc"
    once = one(spark, s, clean_lines)
    assert one(spark, once, clean_lines) == once


@pytest.mark.parametrize(
    "content,expected",
    [
        ("", "content cannot be empty"),
        ("   ", "content too short (minimum 10 words, got 0)"),
        (" ".join(["w"] * 9), "content too short (minimum 10 words, got 9)"),
        (" ".join(["w"] * 10), None),
        (" ".join(["w"] * 10), None),
        (" ".join(["w"] * 10000), None),
        (" ".join(["w"] * 10001), "content too long (maximum 10000 words, got 10001)"),
    ],
)
def test_validate_content(spark, content, expected):
    assert one(spark, content, validate_content) == expected


def test_word_count_unicode_space(spark):
    assert one(spark, "a b　c d​e", word_count) == 4


@pytest.mark.parametrize(
    "text,expected",
    [
        ("hi", "hi"),
        ("é" * 300, "é" * 250),
        ("a" + "é" * 300, "a" + "é" * 249 + "�"),
        ("ab" + "中" * 200, "ab" + "中" * 166),
        ("abc" + "中" * 200, "abc" + "中" * 165 + "\ufffd\ufffd"),
    ],
)
def test_byte_prefix(spark, text, expected):
    assert one(spark, text, lambda c: byte_prefix(c, 500)) == expected


def test_trim_matches_python_helper(spark):
    s = "\u0085  x y 　\t"
    assert one(spark, s, ws_trim) == py_trim(s) == "x y"
    assert py_trim("\x1cx\x1f") == "\x1cx\x1f"  # not white space for the original tool
