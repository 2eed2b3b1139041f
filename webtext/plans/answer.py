"""End-to-end plans: answering user turns (A17) and the page tool.

Shuffles in :func:`answer_requests`: the pages join on url (inside the page
tool), one per-request aggregation over the union of rejected and executed
calls, and the request-keyed joins of decisions, outputs and post-processing.
The tool catalog is a side of the registry's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from ..operators.agent import (
    AGENT_MAX_TOKENS,
    Tool,
    ToolRegistry,
    analysis_request,
    arg_text,
    explode_calls,
    low_confidence,
    parse_decision,
    post_process,
    post_process_request,
    route_decision,
    run_calls,
    validate_calls,
)
from ..operators.completers import complete, replay_completer
from ..operators.pages import scrape_urls, tool_response
from ..session import reliable_checkpoint

# The page tool as registered by the tool server.
SCRAPE_URL_DESCRIPTION = "Scrape content from a single URL and extract text, title, and metadata"
SCRAPE_URL_PARAMS = {
    "url": ("string", "The URL to scrape"),
    "selector": ("string", "Optional CSS selector to extract specific content from the page"),
}


def scrape_url_handler(calls: DataFrame, ctx: dict) -> DataFrame:
    """The page tool over a snapshot table ``ctx['pages']``: (url, selector) -> tool response."""
    req = calls.select("request_id", "call_idx", arg_text("url").alias("url"), arg_text("selector").alias("selector"))
    rows = scrape_urls(req, ctx["pages"], "selector")
    return tool_response(rows).select("request_id", "call_idx", "parts", "is_error")


def default_registry() -> ToolRegistry:
    return ToolRegistry().register(
        Tool("scrape_url", SCRAPE_URL_DESCRIPTION, SCRAPE_URL_PARAMS, ["url"], scrape_url_handler)
    )


def read_document_handler(calls: DataFrame, ctx: dict) -> DataFrame:
    """The document tool over ``ctx['documents']`` (doc_id, text, source, n_chars).

    Parts: a heading and the whole text. A document that is missing or shorter
    than ``min_chars`` is an error; of several rows of one id the largest
    (n_chars, text, source) counts. Only documents that are asked for shuffle."""
    args = F.col("arguments")
    req = calls.select(
        "request_id", "call_idx", args["doc_id"]["text"].try_cast("long").alias("doc_id"),
        F.coalesce(args["min_chars"]["text"].try_cast("double"), F.lit(0.0)).alias("min_chars"),
        F.coalesce(args["with_source"]["text"] == "true", F.lit(False)).alias("with_source"),
    )
    docs = ctx["documents"].join(req.select("doc_id"), "doc_id", "left_semi")
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("n_chars", "text", "source")).alias("doc"))
    j = req.join(docs, "doc_id", "left")
    cause = F.when(F.col("doc").isNull(), F.lit("no such document")).when(F.col("doc.n_chars") < F.col("min_chars"), F.lit("document too short"))
    head = F.concat(F.lit("Document "), F.col("doc_id"), F.when(F.col("with_source"), F.concat(F.lit(" from "), F.coalesce("doc.source", F.lit("")))).otherwise(F.lit("")))
    parts = F.when(cause.isNotNull(), F.array(F.concat(F.lit("Error reading document: "), cause))).otherwise(F.array(head, F.coalesce("doc.text", F.lit(""))))
    return j.select("request_id", "call_idx", parts.alias("parts"), cause.isNotNull().alias("is_error"))


def library_registry() -> ToolRegistry:
    """The page tool and a document tool with integer, number and boolean parameters."""
    params = {
        "doc_id": ("integer", "The document to read"),
        "min_chars": ("number", "Optional least length of the document"),
        "with_source": ("boolean", "Whether the heading names the source"),
    }
    return default_registry().register(Tool("read_document", "Read a stored document", params, ["doc_id"], read_document_handler))


def decision_completer(decisions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Recorded decisions as a completer: a completions table, or ``(request_id,
    decision_text)``, where a NULL text is an answer without a choice."""
    if "decision_text" not in decisions.columns:
        return replay_completer(decisions)
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    return replay_completer(decisions.select(
        "request_id", F.col("decision_text").isNotNull().cast("int").alias("n_choices"), F.col("decision_text").alias("content"),
        none.alias("model"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"), zero.alias("total_tokens"), none.alias("error")))


def decide(
    requests: DataFrame,
    decisions: DataFrame | Callable[[DataFrame], DataFrame],
    registry: ToolRegistry | None = None,
    model: str = "agent-model",
    max_tokens: int = AGENT_MAX_TOKENS,
    materialize: bool = False,
) -> DataFrame:
    """The analysis request of every turn, its completion (S4), the decoded
    decision and its route. ``decisions`` is a completer or a table of recorded
    answers. Where the completion failed, ``error`` says why and there is no
    decision and no route.

    With ``materialize`` the decoded decisions (one row per request) are cut
    from their lineage into the shared checkpoint folder: the answer plan
    reads them in several branches, and the decoder is a Python step that
    would otherwise run once per branch."""
    completer = decisions if callable(decisions) else decision_completer(decisions)
    asked = analysis_request(requests.select("request_id", "user_text"), registry or default_registry(), model, max_tokens)
    asked = asked.select("request_id", "system_prompt", F.col("user_prompt").alias("prompt"), F.col("user_text").alias("content"), "chat_request", F.lit(0).alias("max_length"))
    answers = complete(asked, completer).select(
        "request_id", F.col("text").alias("decision_text"), F.concat(F.lit("agent processing failed: "), F.col("error")).alias("error"))
    d = requests.join(answers, "request_id", "left")
    out = route_decision(low_confidence(parse_decision(d)))
    ok = F.col("error").isNull()
    out = out.withColumns({c: F.when(ok, F.col(c)) for c in ("decision", "parse_ok", "confidence_note", "route")})
    return reliable_checkpoint(out) if materialize else out


def call_outcomes(decided: DataFrame, registry: ToolRegistry, ctx: dict) -> DataFrame:
    """Every exploded call with exactly one status: rejected / failed / succeeded."""
    calls = validate_calls(explode_calls(decided), registry.catalog(decided.sparkSession))
    rejected = calls.filter(F.col("validation_error").isNotNull()).select(
        "request_id", "call_idx", "name", F.lit("rejected").alias("status"),
        F.col("validation_error").alias("detail"), F.lit(None).cast("string").alias("result"),
    )
    valid = calls.filter(F.col("validation_error").isNull())
    executed = run_calls(valid, registry, ctx).select(
        "request_id", "call_idx", "name",
        F.when(F.col("is_error"), F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
        F.lit(None).cast("string").alias("detail"), "result",
    )
    return rejected.unionByName(executed)


def answer_requests(
    requests: DataFrame,
    decisions: DataFrame | Callable[[DataFrame], DataFrame],
    registry: ToolRegistry,
    ctx: dict,
    post_completer: Callable[[DataFrame], DataFrame],
    model: str = "agent-model",
    max_tokens: int = 1000,
) -> DataFrame:
    """One row per request (``request_id, user_text``) with its route, call
    counts, aggregated tool output and post-processed final output; ``error``
    where the model gave no decision."""
    decided = decide(requests, decisions, registry, model, max_tokens, materialize=True)
    outcomes = call_outcomes(decided, registry, ctx)
    per_req = outcomes.groupBy("request_id").agg(
        F.count(F.when(F.col("status") == "rejected", 1)).alias("n_rejected"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"),
        F.count(F.when(F.col("status") == "succeeded", 1)).alias("n_succeeded"),
        F.array_sort(
            F.collect_list(F.when(F.col("result").isNotNull() & (ws_trim(F.col("result")) != ""), F.struct("call_idx", "result")))
        ).alias("_r"),
    )
    content = ws_trim(F.array_join(F.transform("_r", lambda r: r["result"]), "\n\n"))
    base = decided.join(per_req.select("request_id", "n_rejected", "n_failed", "n_succeeded", content.alias("content")),
                        "request_id", "left")
    base = base.select(
        "request_id",
        "user_text",
        "route",
        "parse_ok",
        F.col("decision.message").alias("message"),
        "confidence_note",
        F.when(F.col("route") == "explain", F.col("decision.explanation")).alias("explanation"),
        F.coalesce(F.when(F.col("error").isNull(), F.size("decision.tool_calls")), F.lit(0)).cast("long").alias("n_calls"),
        "error",
        F.coalesce("n_rejected", F.lit(0)).cast("long").alias("n_rejected"),
        F.coalesce("n_failed", F.lit(0)).cast("long").alias("n_failed"),
        F.coalesce("n_succeeded", F.lit(0)).cast("long").alias("n_succeeded"),
        F.when(F.col("route") == "tools", F.coalesce(F.col("content"), F.lit(""))).alias("content"),
        F.when(F.col("route") == "tools", F.col("decision.post_process")).otherwise(F.lit("")).alias("post_process"),
    )
    post = post_process(post_process_request(base, model, max_tokens), post_completer)
    return post.select(
        "request_id", "route", "parse_ok", "message", "confidence_note", "explanation", "n_calls",
        "n_rejected", "n_failed", "n_succeeded", F.col("content").alias("tool_output"), "final_output", "post_error", "error",
    )
