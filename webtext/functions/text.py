"""Column expressions for text: white space, line cleaning, word counts, byte cuts.

Everything here is a plain Catalyst expression (codegen, no Python worker).
White space follows the Unicode White_Space property, which is what the
original tool's trimming and word splitting use; Spark's one-argument
``trim`` strips only U+0020 and must not be used for these semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points (TAB..CR, SPACE, NEL, NBSP,
# OGHAM SPACE MARK, EN QUAD..HAIR SPACE, LINE SEP, PARAGRAPH SEP, NNBSP, MMSP,
# IDEOGRAPHIC SPACE).
WS_CHARS = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java regex class for one non-white-space character.
NON_WS_RE = "[^\\p{IsWhite_Space}]+"
WS_RUN_RE = "\\p{IsWhite_Space}+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_trim(s: str) -> str:
    """Python twin of :func:`ws_trim` for per-row helpers (``str.strip()``
    would also strip U+001C..U+001F)."""
    return s.strip(WS_CHARS)


def ws_trim(col: Column | str) -> Column:
    """Trim Unicode white space from both ends."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def clean_lines(col: Column | str) -> Column:
    """Split on LF, trim every line, drop blank lines, rejoin with LF."""
    lines = F.split(_c(col), "\n", -1)
    trimmed = F.transform(lines, lambda x: F.trim(x, F.lit(WS_CHARS)))
    return F.array_join(F.filter(trimmed, lambda x: x != F.lit("")), "\n")


def words(col: Column | str) -> Column:
    """Array of the white-space separated fields of a string."""
    return F.filter(F.split(_c(col), WS_RUN_RE, -1), lambda x: x != F.lit(""))


def word_count(col: Column | str) -> Column:
    """Number of white-space separated fields (no array is materialised)."""
    return F.regexp_count(_c(col), F.lit(NON_WS_RE)).cast("long")


def validate_content(col: Column | str, n_words: Column | None = None) -> Column:
    """Error text of the summarisation gate, NULL when the content passes.

    Pass ``n_words`` when the word count is already a column: Spark does not
    share a subexpression between later CASE conditions, so it would count
    the words of a long text again for each branch."""
    c = _c(col)
    n = word_count(c) if n_words is None else n_words
    return (
        F.when(c == F.lit(""), F.lit("content cannot be empty"))
        .when(n < 10, F.format_string("content too short (minimum 10 words, got %d)", n))
        .when(n > 10000, F.format_string("content too long (maximum 10000 words, got %d)", n))
    )


def byte_length(col: Column | str) -> Column:
    return F.octet_length(_c(col)).cast("long")


def byte_prefix(col: Column | str, n_bytes: int) -> Column:
    """First ``n_bytes`` UTF-8 bytes of a string, as a byte slice would be seen
    once re-encoded as valid text: whole characters are kept and every byte of
    a character cut in two becomes one U+FFFD."""
    c = _c(col)
    # characters that start inside the first n bytes (a cut one counts once)
    started = F.char_length(F.substring(F.encode(c, "UTF-8"), 1, n_bytes).cast("string"))
    whole = F.when(F.octet_length(F.left(c, started)) <= n_bytes, started).otherwise(started - 1)
    head = F.left(c, whole)
    cut = F.lit(n_bytes) - F.octet_length(head)
    return F.when(F.octet_length(c) <= n_bytes, c).otherwise(
        F.concat(head, F.repeat(F.lit("\ufffd"), cut))
    )


def split_trimmed(col: Column | str, sep: str) -> Column:
    """Split on a literal separator, trim each piece, drop empty pieces."""
    parts = F.split(_c(col), _regex_quote(sep), -1)
    trimmed = F.transform(parts, lambda x: F.trim(x, F.lit(WS_CHARS)))
    return F.filter(trimmed, lambda x: x != F.lit(""))


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in s)
