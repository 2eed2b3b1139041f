"""Summarisation requests and responses (S1-S9) as column expressions.

A request table has ``request_id, content, max_length, style, language``.
Prompts, chat requests and responses are built with ``concat`` / ``when`` /
``struct``; completions come from :mod:`webtext.operators.completers`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_length, split_trimmed, validate_content, word_count, ws_trim

# Prompt and system texts of the summariser.
SUMMARY_SYSTEM = "You are a helpful assistant that creates clear, accurate summaries of text content."
PROMPT_HEAD = "Please summarize the following text"
LENGTH_CLAUSE = " in approximately %d words or less"
STYLE_CLAUSES = {
    "detailed": ". Provide a detailed summary that captures the main points, key arguments, and important details",
    "bullet_points": ". Format the summary as bullet points, highlighting the key information",
    "concise": ". Provide a concise summary focusing on the most important information",
}
STYLE_OTHER = ". Provide a clear and informative summary"
KEYWORD_SYSTEM = "You extract key terms and phrases from text. Return only the keywords separated by commas."
KEYWORD_PROMPT = (
    "Extract 5-10 key terms or phrases from the following text. "
    "Return only the keywords, separated by commas:\n\n"
)
DEFAULT_MAX_LENGTH = 200
DEFAULT_STYLE = "concise"
SUMMARY_TEMPERATURE = 0.3
KEYWORD_TEMPERATURE = 0.2
KEYWORD_MAX_TOKENS = 100


def request_defaults(requests: DataFrame) -> DataFrame:
    """max_length 0/NULL -> 200 (negative kept); empty style -> concise; NULL language -> ''."""
    ml = F.coalesce(F.col("max_length").cast("int"), F.lit(0))
    style = F.coalesce(F.col("style"), F.lit(""))
    return requests.withColumns(
        {
            "max_length": F.when(ml == 0, F.lit(DEFAULT_MAX_LENGTH)).otherwise(ml),
            "style": F.when(style == "", F.lit(DEFAULT_STYLE)).otherwise(style),
            "language": F.coalesce(F.col("language"), F.lit("")),
        }
    )


def style_clause(style: Column) -> Column:
    expr = None
    for name, text in STYLE_CLAUSES.items():
        expr = (F.when(style == name, F.lit(text)) if expr is None else expr.when(style == name, F.lit(text)))
    return expr.otherwise(F.lit(STYLE_OTHER))


def prompt_expr(content: Column, max_length: Column, style: Column, language: Column) -> Column:
    """S2 on already-defaulted columns."""
    return F.concat(
        F.lit(PROMPT_HEAD),
        F.when(max_length > 0, F.format_string(LENGTH_CLAUSE, max_length)).otherwise(F.lit("")),
        style_clause(style),
        F.when(language != "", F.concat(F.lit(" in "), language)).otherwise(F.lit("")),
        F.lit(":\n\n"),
        content,
    )


def summary_prompt(requests: DataFrame) -> DataFrame:
    """S1 + S2: defaulted request with its ``prompt``."""
    r = request_defaults(requests)
    return r.withColumn("prompt", prompt_expr(F.col("content"), F.col("max_length"), F.col("style"), F.col("language")))


def chat_request(system: Column | str, user: Column, model: str, max_tokens: Column | int, temperature: float) -> Column:
    sys_c = F.lit(system) if isinstance(system, str) else system
    mt = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    return F.struct(
        F.lit(model).alias("model"),
        F.array(
            F.struct(F.lit("system").alias("role"), sys_c.alias("content")),
            F.struct(F.lit("user").alias("role"), user.alias("content")),
        ).alias("messages"),
        mt.cast("int").alias("max_tokens"),
        F.lit(temperature).cast("double").alias("temperature"),
    )


def summary_chat_request(requests: DataFrame, model: str, max_tokens: int = 0) -> DataFrame:
    """S3: the chat request of each summary (system line, prompt, temperature 0.3)."""
    p = summary_prompt(requests)
    return p.withColumn(
        "chat_request", chat_request(SUMMARY_SYSTEM, F.col("prompt"), model, max_tokens, SUMMARY_TEMPERATURE)
    )


def summary_response(requests: DataFrame, completions: DataFrame) -> DataFrame:
    """Join completions (``request_id, text, model, prompt_tokens,
    completion_tokens, total_tokens, error``) to defaulted requests.

    Rows whose completion failed carry ``error`` and NULL response fields.
    """
    r = request_defaults(requests)
    c = completions.select(
        "request_id",
        F.col("text").alias("_text"),
        F.col("model").alias("_model"),
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        F.col("error").alias("_err"),
    )
    return _respond(r.join(c, "request_id", "left"), r.columns)


def _respond(j: DataFrame, keep: list[str]) -> DataFrame:
    err = F.coalesce(F.col("_err"), F.lit("no completion"))
    ok = F.col("_text").isNotNull() & F.col("_err").isNull()
    summary = ws_trim(F.col("_text"))
    return j.select(
        *[x for x in keep if x not in ("content",)],
        F.when(ok, summary).alias("summary"),
        F.when(ok, byte_length("content")).alias("original_size"),
        F.when(ok, byte_length(summary)).alias("summary_size"),
        F.when(ok, F.col("_model")).alias("model"),
        F.when(ok, F.col("total_tokens").cast("long")).alias("tokens_used"),
        F.when(
            ok,
            F.create_map(
                F.lit("style"), F.col("style"),
                F.lit("language"), F.col("language"),
                F.lit("prompt_tokens"), F.col("prompt_tokens").cast("long").cast("string"),
                F.lit("completion_tokens"), F.col("completion_tokens").cast("long").cast("string"),
            ),
        ).alias("metadata"),
        F.when(~ok, err).alias("error"),
    )


def keyword_request(requests: DataFrame, model: str) -> DataFrame:
    """The keyword request of each row (own system line, 100 tokens, temperature 0.2)."""
    prompt = F.concat(F.lit(KEYWORD_PROMPT), F.col("content"))
    return requests.withColumns(
        {
            "keyword_prompt": prompt,
            "chat_request": chat_request(KEYWORD_SYSTEM, prompt, model, KEYWORD_MAX_TOKENS, KEYWORD_TEMPERATURE),
        }
    )


def parse_keywords(col: Column | str) -> Column:
    """Split on commas, trim, drop empties; order and duplicates kept."""
    return split_trimmed(col, ",")


def summary_with_keywords(summaries: DataFrame, keyword_completions: DataFrame) -> DataFrame:
    """Summary response plus keywords. A failed summary fails the row (its
    keywords are not used); a failed keyword completion only gives ``[]``."""
    k = keyword_completions.select(
        "request_id",
        F.when(F.col("error").isNull() & F.col("text").isNotNull(), parse_keywords(F.col("text"))).alias("_kw"),
    )
    j = summaries.join(k, "request_id", "left")
    return j.withColumn(
        "keywords",
        F.when(F.col("error").isNull(), F.coalesce(F.col("_kw"), F.array().cast("array<string>"))),
    ).drop("_kw")


def validate_requests(requests: DataFrame) -> DataFrame:
    """The content gate as a column (NULL = passes)."""
    counted = requests.withColumn("n_words", word_count(F.col("content")))
    return counted.withColumn("validation_error", validate_content(F.col("content"), F.col("n_words")))
