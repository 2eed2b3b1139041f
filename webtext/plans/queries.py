"""Registered queries: one per operator of the inventory, over the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the SQL in :mod:`webtext.plans.oracle`. Arrays and maps are also
given as scalar columns (joined text, counts) so results compare by value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_length, clean_lines, validate_content, word_count
from ..operators import agent as A
from ..operators import completers as C
from ..operators import metrics as M
from ..operators import pages as P
from ..operators import sketches as K
from ..operators import snapshots
from ..operators import summarize as S
from ..operators.table_tools import table_tool
from ..session import written_table
from ..sources import derived as D
from ..sources import tables
from .answer import answer_requests, call_outcomes, decide, default_registry, library_registry
from .stream_queries import stream_answer_q, stream_extract_q, stream_host_windows_q, stream_line_sessions_q, stream_sessions_q, stream_summary_windows_q

# The given tables are one row group each, so the queries ask for spread scans.
load_pages = partial(tables.load_pages, spread=True)
load_documents = partial(tables.load_documents, spread=True)
load_conversations = partial(tables.load_conversations, spread=True)

MODEL = "summary-model"
AGENT_MODEL = "agent-model"


def _records(spark, sf, selector=None) -> DataFrame:
    return P.extract_pages(load_pages(spark, sf), keep=["page_id"], selector=selector)


def _nl(col: str) -> F.Column:
    return F.array_join(F.col(col), "\n")


# -- pages ------------------------------------------------------------------


def load_pages_q(spark, sf):
    p = load_pages(spark, sf)
    return p.select("page_id", "url", byte_length("html").alias("html_bytes"), "status_code", "content_type")


def page_title(spark, sf):
    return _records(spark, sf).select("page_id", "title")


def page_metadata(spark, sf):
    r = _records(spark, sf)
    return r.select("page_id", F.size("metadata").cast("long").alias("n_meta"), F.to_json("metadata").alias("metadata_json"))


def page_links(spark, sf):
    r = _records(spark, sf)
    return r.select("page_id", F.size("links").cast("long").alias("n_links"), _nl("links").alias("links_text"))


def page_images(spark, sf):
    r = _records(spark, sf)
    return r.select("page_id", F.size("images").cast("long").alias("n_images"), _nl("images").alias("images_text"))


def _media_records(spark, sf) -> DataFrame:
    return P.extract_pages(D.pages_with_media(load_pages(spark, sf)), keep=["page_id"])


def page_metadata_derived(spark, sf):
    r = _media_records(spark, sf)
    return r.select("page_id", F.size("metadata").cast("long").alias("n_meta"), F.to_json("metadata").alias("metadata_json"))


def page_images_derived(spark, sf):
    r = _media_records(spark, sf)
    return r.select("page_id", F.size("images").cast("long").alias("n_images"), _nl("images").alias("images_text"))


def select_article(spark, sf):
    r = _records(spark, sf, selector="article")
    return r.select("page_id", "content", "clean_text")


def select_text(spark, sf):
    r = _records(spark, sf, selector="h1")
    return r.select("page_id", "content", "clean_text")


def main_content(spark, sf):
    r = _records(spark, sf)
    return r.select("page_id", "matched_selector", "content", "clean_text")


def body_fallback(spark, sf):
    r = _records(spark, sf)
    return r.filter(F.col("matched_selector") == "body").select("page_id", "content", "clean_text")


def clean_text(spark, sf):
    d = D.padded_documents(load_documents(spark, sf))
    c = clean_lines(F.col("text"))
    return d.select("doc_id", c.alias("clean_text"), byte_length(c).alias("clean_bytes"))


def page_record(spark, sf):
    r = _records(spark, sf)
    return r.select(
        "page_id", "url", "title", "content", "clean_text",
        F.size("links").cast("long").alias("n_links"),
        F.size("images").cast("long").alias("n_images"),
        F.size("metadata").cast("long").alias("n_meta"),
        _nl("links").alias("links_text"),
        "status_code", "content_type",
    )


def page_stats(spark, sf):
    return P.page_stats(_records(spark, sf)).select("page_id", "links_count", "images_count", "content_bytes")


def _batch_rows(spark, sf):
    pages = tables.load_pages(spark, sf)  # hits are spread after the lookup
    return P.extract_batch(D.url_batches(pages), pages)


def extract_batch(spark, sf):
    rows, _ = _batch_rows(spark, sf)
    return rows.select("batch_id", "idx", "url", "title", byte_length("clean_text").alias("clean_bytes"), "error")


def extract_batch_summary(spark, sf):
    _, summary = _batch_rows(spark, sf)
    return summary.select("batch_id", F.col("n_urls").cast("long").alias("n_urls"),
                          F.col("n_errors").cast("long").alias("n_errors"), "batch_error")


def _responses(spark, sf, full=False):
    rows, _ = _batch_rows(spark, sf)
    resp = P.tool_response_full(rows) if full else P.tool_response(rows)
    return resp.select(
        "batch_id", "idx", "is_error",
        F.size("parts").cast("long").alias("n_parts"),
        F.array_join("parts", "\n\n").alias("result"),
        F.col("structured.url").alias("s_url"),
        F.col("structured.content").alias("s_content"),
    )


def tool_response(spark, sf):
    return _responses(spark, sf)


def tool_response_full(spark, sf):
    return _responses(spark, sf, full=True)


def tool_error(spark, sf):
    return _responses(spark, sf).filter("is_error").select("batch_id", "idx", "result")


def extract_batch_as_of(spark, sf):
    """P12 where every URL has three stored responses and every request its own time."""
    pages, events = tables.load_pages(spark, sf), tables.load_events(spark, sf)
    rows, _ = P.extract_batch_as_of(D.dated_items(D.url_batches(pages), events), D.page_responses(pages, events))
    return rows.select("batch_id", "idx", "url", "requested_at", "fetched_at", "title", byte_length("clean_text").alias("clean_bytes"), "status_code", "error")


# -- summarisation -------------------------------------------------------------


def _requests(spark, sf):
    return D.summary_requests(load_documents(spark, sf))


def _recorded(spark, sf):
    return D.recorded_completions(load_documents(spark, sf))


def request_defaults(spark, sf):
    return S.request_defaults(_requests(spark, sf)).select("request_id", "max_length", "style", "language")


def summary_prompt(spark, sf):
    return S.summary_prompt(_requests(spark, sf)).select("request_id", "prompt")


def summary_chat_request(spark, sf):
    r = S.summary_chat_request(_requests(spark, sf), MODEL, 0)
    cr = F.col("chat_request")
    return r.select(
        "request_id", cr["model"].alias("model"),
        F.size(cr["messages"]).cast("long").alias("n_messages"),
        cr["messages"][0]["role"].alias("role_0"), cr["messages"][0]["content"].alias("content_0"),
        cr["messages"][1]["role"].alias("role_1"), cr["messages"][1]["content"].alias("content_1"),
        cr["max_tokens"].alias("max_tokens"), cr["temperature"].alias("temperature"),
    )


def complete_requests(spark, sf):
    comp = C.complete(_requests(spark, sf), C.replay_completer(_recorded(spark, sf), "summary"))
    return comp.select("request_id", "text", "model", "prompt_tokens", "completion_tokens", "total_tokens", "error")


def _summaries(spark, sf):
    req = _requests(spark, sf)
    comp = C.complete(req, C.replay_completer(_recorded(spark, sf), "summary"))
    return S.summary_response(req, comp)


def summary_response(spark, sf):
    r = _summaries(spark, sf)
    return r.select(
        "request_id", "summary", "original_size", "summary_size", "model", "tokens_used",
        F.col("metadata")["style"].alias("meta_style"), F.col("metadata")["language"].alias("meta_language"),
        F.col("metadata")["prompt_tokens"].alias("meta_prompt_tokens"),
        F.col("metadata")["completion_tokens"].alias("meta_completion_tokens"),
        "error",
    )


def keyword_request(spark, sf):
    r = S.keyword_request(_requests(spark, sf), MODEL)
    cr = F.col("chat_request")
    return r.select(
        "request_id", "keyword_prompt", cr["messages"][0]["content"].alias("system_text"),
        cr["max_tokens"].alias("max_tokens"), cr["temperature"].alias("temperature"),
    )


def _keyword_completions(spark, sf):
    return C.complete(_requests(spark, sf), C.replay_completer(_recorded(spark, sf), "keywords"))


def parse_keywords(spark, sf):
    k = _keyword_completions(spark, sf).filter(F.col("error").isNull())
    kw = S.parse_keywords(F.col("text"))
    return k.select("request_id", F.size(kw).cast("long").alias("n_keywords"), F.array_join(kw, "|").alias("keywords_text"))


def summary_with_keywords(spark, sf):
    r = S.summary_with_keywords(_summaries(spark, sf), _keyword_completions(spark, sf))
    return r.select(
        "request_id", "summary", "error",
        F.size("keywords").cast("long").alias("n_keywords"), F.array_join("keywords", "|").alias("keywords_text"),
    )


def validate_content_q(spark, sf):
    d = load_documents(spark, sf).select("doc_id", "text", word_count(F.col("text")).alias("n_words"))
    return d.select("doc_id", "n_words", validate_content(F.col("text"), F.col("n_words")).alias("error"))


def lead_summary(spark, sf):
    req = S.request_defaults(_requests(spark, sf))
    comp = C.complete(req, C.lead_completer)
    return comp.select("request_id", F.col("text").alias("summary"), "completion_tokens")


def extractive_summary(spark, sf):
    req = S.request_defaults(_requests(spark, sf))
    comp = C.complete(req, C.extractive_completer())
    return comp.select("request_id", F.col("text").alias("summary"))


def top_keywords(spark, sf):
    req = _requests(spark, sf)
    return C.top_keywords(req).select("request_id", F.col("rank").cast("long").alias("rank"), "term", "weight")


# -- agent ---------------------------------------------------------------------------


def _user_requests(spark, sf):
    conv = load_conversations(spark, sf)
    turns = A.session_turns(conv.filter(F.col("role") == "user"))
    return D.user_requests(turns)


def _decided(spark, sf, materialize=False):
    req = _user_requests(spark, sf)
    d = decide(req, D.decisions(req, load_pages(spark, sf)), library_registry(), AGENT_MODEL, materialize=materialize)
    return d.filter(F.col("error").isNull())


def _context(spark, sf):
    return {"pages": load_pages(spark, sf), "documents": load_documents(spark, sf)}


def session_turns(spark, sf):
    lines = D.session_lines(load_conversations(spark, sf)).filter(F.col("role") == "user")
    return A.session_turns(lines).select("conv_id", "turn", "text")


def analysis_request(spark, sf):
    r = A.analysis_request(_user_requests(spark, sf), default_registry(), AGENT_MODEL)
    cr = F.col("chat_request")
    return r.select(
        "request_id", "system_prompt", "user_prompt",
        cr["max_tokens"].alias("max_tokens"), cr["temperature"].alias("temperature"),
    )


def parse_decision(spark, sf):
    d = _decided(spark, sf)
    return d.select(
        "request_id", "parse_ok",
        F.col("decision.message").alias("message"), F.col("decision.should_call").alias("should_call"),
        F.col("decision.confidence").alias("confidence"), F.col("decision.explanation").alias("explanation"),
        F.col("decision.post_process").alias("post_process"),
        F.size("decision.tool_calls").cast("long").alias("n_calls"),
    )


def low_confidence(spark, sf):
    return _decided(spark, sf).select("request_id", "confidence_note")


def route_decision(spark, sf):
    return _decided(spark, sf).select("request_id", "route")


def explode_calls(spark, sf):
    c = A.explode_calls(_decided(spark, sf))
    return c.select("request_id", F.col("call_idx").cast("long").alias("call_idx"),
                    F.col("n_calls").cast("long").alias("n_calls"), "name", "reasoning")


def _validated(spark, sf):
    d = _decided(spark, sf)
    return A.validate_calls(A.explode_calls(d), library_registry().catalog(spark))


def validate_calls(spark, sf):
    v = _validated(spark, sf)
    return v.select("request_id", F.col("call_idx").cast("long").alias("call_idx"), "name", "validation_error")


def unknown_tool(spark, sf):
    calls = A.explode_calls(_decided(spark, sf))
    cat = library_registry().catalog(spark).select(F.col("tool_name").alias("name"))
    rej = calls.join(cat, "name", "left_anti")
    return rej.select("request_id", F.col("call_idx").cast("long").alias("call_idx"), "name",
                      F.concat(F.lit("unknown tool: "), F.col("name")).alias("validation_error"))


def _faults(spark, sf, check):
    calls = A.explode_calls(_decided(spark, sf))
    found = check(calls, library_registry().catalog(spark)).filter(F.col("validation_error").isNotNull())
    return found.select("request_id", F.col("call_idx").cast("long").alias("call_idx"), "name", "validation_error")


def missing_params(spark, sf):
    return _faults(spark, sf, A.missing_params)


def param_types(spark, sf):
    return _faults(spark, sf, A.param_types)


def _outcomes(spark, sf):
    return call_outcomes(_decided(spark, sf, materialize=True), library_registry(), _context(spark, sf))


def run_calls(spark, sf):
    o = _outcomes(spark, sf).filter(F.col("status") != "rejected")
    return o.select("request_id", F.col("call_idx").cast("long").alias("call_idx"), "status", "result")


def aggregate_outputs(spark, sf):
    o = _outcomes(spark, sf).filter(F.col("status") != "rejected")
    return A.aggregate_outputs(o).select("request_id", "content")


def _answers(spark, sf):
    req = _user_requests(spark, sf)
    decisions = D.decisions(req, load_pages(spark, sf))
    return answer_requests(req, decisions, library_registry(), _context(spark, sf), C.replay_completer(D.post_completions(req)), AGENT_MODEL)


def post_process_request(spark, sf):
    d = _decided(spark, sf, materialize=True)
    outcomes = call_outcomes(d, library_registry(), _context(spark, sf))
    outs = A.aggregate_outputs(outcomes.filter(F.col("status") != "rejected"))
    base = d.filter(F.col("route") == "tools").select(
        "request_id", "user_text", F.col("decision.post_process").alias("post_process")
    ).join(outs, "request_id", "left")
    r = A.post_process_request(base, AGENT_MODEL)
    return r.filter("needs_model").select("request_id", "prompt", F.col("post_max_tokens").cast("long").alias("max_tokens"))


def post_process(spark, sf):
    return _answers(spark, sf).select("request_id", "final_output", "post_error")


def answer_requests_q(spark, sf):
    return _answers(spark, sf)


# -- metrics ---------------------------------------------------------------------------


def extract_metrics(spark, sf):
    rows, _ = _batch_rows(spark, sf)
    return M.extract_metrics(rows)


def extract_rollup(spark, sf):
    rows, _ = _batch_rows(spark, sf)
    return M.extract_rollup(rows)


def _day(events: DataFrame, rows: DataFrame, number) -> DataFrame:
    return D.with_event_time(rows, events, number, "at").withColumn("day", F.to_date("at"))


def _page_sketches(spark, sf) -> DataFrame:
    """M1's sketches per host and day, stored."""
    dated = _day(tables.load_events(spark, sf), _records(spark, sf), F.col("page_id") * 7)
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return written_table(K.stored_sketches(dated, {"host": host, "day": F.col("day")}, F.col("url"), byte_length("clean_text"), links=F.size("links")), "page-sketches")


def host_sketches(spark, sf):
    """Per host and for all hosts: pages, links, distinct URLs and quantiles of the text sizes, from the stored sketches alone."""
    stored = _page_sketches(spark, sf)
    hosts = K.merged_sketches(stored, ["host"], ["links"])
    whole = K.merged_sketches(hosts, [], ["links"]).withColumn("host", F.lit("*"))
    return hosts.unionByName(whole).select(
        "host", F.col("rows").alias("pages"), "links", K.distinct_count().alias("urls"), K.size_quantile(0.5).alias("p50_bytes"), K.size_quantile(0.95).alias("p95_bytes"))


def summary_sketches(spark, sf):
    """M2 per model, merged from sketches per model, style and day: responses, distinct summaries, quantiles of their sizes."""
    dated = _day(tables.load_events(spark, sf), _summaries(spark, sf).where(F.col("error").isNull()), F.col("request_id") * 11)
    stored = K.stored_sketches(dated, {"model": F.col("model"), "style": F.col("style"), "day": F.col("day")}, F.col("summary"), F.col("summary_size"))
    return K.merged_sketches(written_table(stored, "summary-sketches"), ["model"]).select(
        "model", "rows", K.size_quantile(0.5).alias("p50_bytes"), K.size_quantile(0.99).alias("p99_bytes"))


def snapshot_difference(spark, sf):
    return snapshots.snapshot_difference(*D.page_snapshots(tables.load_pages(spark, sf)))


def top_keywords_salted(spark, sf):
    req = _requests(spark, sf)
    top = C.top_keywords(req, hot=C.hot_terms(req))
    return top.select("request_id", F.col("rank").cast("long").alias("rank"), "term", "weight")


def count_words(text: str | None, least: int | None):
    """Rows of the word counting tool: every word of at least ``least`` places, in order of its first place."""
    found: dict[str, int] = {}
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        found[word] = found.get(word, 0) + 1
    return ((w, n) for w, n in found.items() if n >= (least or 1))


def counting_registry() -> A.ToolRegistry:
    return A.ToolRegistry().register(table_tool(
        "count_words", "Count the words of a text", {"text": ("string", "The text"), "least": ("integer", "Optional least number of places")}, ["text"],
        {"word": T.StringType(), "places": T.LongType()}, count_words))


def table_tool_calls(spark, sf):
    """A12 with a tool that is a table function: the words of every user turn."""
    registry = counting_registry()
    calls = A.validate_calls(D.counting_calls(_user_requests(spark, sf)), registry.catalog(spark)).where(F.col("validation_error").isNull())
    out = A.run_calls(calls, registry, {})
    return out.select("request_id", F.col("call_idx").cast("long").alias("call_idx"), "is_error", "result")


def summary_metrics(spark, sf):
    return M.summary_metrics(_summaries(spark, sf))


def agent_metrics(spark, sf):
    return M.agent_metrics(_decided(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_pages": load_pages_q,
    "page_title": page_title,
    "page_metadata": page_metadata,
    "page_links": page_links,
    "page_images": page_images,
    "select_text": select_text,
    "select_article": select_article,
    "page_metadata_derived": page_metadata_derived,
    "page_images_derived": page_images_derived,
    "main_content": main_content,
    "body_fallback": body_fallback,
    "clean_text": clean_text,
    "page_record": page_record,
    "page_stats": page_stats,
    "extract_batch": extract_batch,
    "extract_batch_summary": extract_batch_summary,
    "extract_batch_as_of": extract_batch_as_of,
    "tool_response": tool_response,
    "tool_response_full": tool_response_full,
    "tool_error": tool_error,
    "request_defaults": request_defaults,
    "summary_prompt": summary_prompt,
    "summary_chat_request": summary_chat_request,
    "complete_requests": complete_requests,
    "summary_response": summary_response,
    "keyword_request": keyword_request,
    "parse_keywords": parse_keywords,
    "summary_with_keywords": summary_with_keywords,
    "validate_content": validate_content_q,
    "lead_summary": lead_summary,
    "extractive_summary": extractive_summary,
    "top_keywords": top_keywords,
    "session_turns": session_turns,
    "analysis_request": analysis_request,
    "parse_decision": parse_decision,
    "low_confidence": low_confidence,
    "route_decision": route_decision,
    "explode_calls": explode_calls,
    "unknown_tool": unknown_tool,
    "missing_params": missing_params,
    "param_types": param_types,
    "validate_calls": validate_calls,
    "run_calls": run_calls,
    "aggregate_outputs": aggregate_outputs,
    "post_process_request": post_process_request,
    "post_process": post_process,
    "answer_requests": answer_requests_q,
    "extract_metrics": extract_metrics,
    "extract_rollup": extract_rollup,
    "host_sketches": host_sketches,
    "summary_sketches": summary_sketches,
    "snapshot_difference": snapshot_difference,
    "top_keywords_salted": top_keywords_salted,
    "table_tool_calls": table_tool_calls,
    "summary_metrics": summary_metrics,
    "agent_metrics": agent_metrics,
    "stream_extract": stream_extract_q,
    "stream_sessions": stream_sessions_q,
    "stream_answer": stream_answer_q,
    "stream_host_windows": stream_host_windows_q,
    "stream_summary_windows": stream_summary_windows_q,
    "stream_line_sessions": stream_line_sessions_q,
}
