"""Flagship plan: pages -> main text -> content gate -> summary request -> summary.

Pages are parsed once: the requests (clean text, gate) are cut from their
lineage into the shared folder, as the extractive summary reads them in
several branches and parsing is the dearest step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import validate_content, word_count
from ..operators.completers import complete, extractive_completer
from ..operators.pages import extract_pages
from ..operators.summarize import request_defaults, summary_prompt, summary_response
from ..session import reliable_checkpoint


def summarize_pages(pages: DataFrame, max_length: int = 50, style: str = "concise") -> DataFrame:
    recs = extract_pages(pages, keep=["page_id"])
    req = recs.select(
        F.col("page_id").alias("request_id"),
        "url",
        "title",
        F.col("clean_text").alias("content"),
        F.lit(max_length).alias("max_length"),
        F.lit(style).alias("style"),
        F.lit("").alias("language"),
    ).withColumn("n_words", word_count(F.col("content")))
    req = req.withColumn("validation_error", validate_content(F.col("content"), F.col("n_words"))).drop("n_words")
    req = reliable_checkpoint(req)
    valid = req.filter(F.col("validation_error").isNull()).drop("validation_error")
    resp = summary_response(valid, complete(summary_prompt(request_defaults(valid)), extractive_completer()))
    out = ("summary", "original_size", "summary_size", "model", "tokens_used")
    done = resp.select("request_id", "url", "title", *out, "error")
    rejected = req.filter(F.col("validation_error").isNotNull())
    return done.unionByName(rejected.select("request_id", "url", "title", F.col("validation_error").alias("error")), allowMissingColumns=True)
