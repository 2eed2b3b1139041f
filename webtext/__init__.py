"""webtext: page extraction, summarisation requests and tool-call answering as Spark jobs.

Main entry points (all DataFrame -> DataFrame):

* pages: :func:`extract_pages`, :func:`extract_batch`, :func:`scrape_urls`, :func:`tool_response`;
  as of a time :func:`extract_batch_as_of`, :func:`scrape_urls_as_of`, :func:`asof_join`; crawls :func:`snapshot_difference`
* text: :func:`clean_lines`, :func:`validate_content`, :func:`ws_trim`, :func:`byte_prefix`
* summaries: :func:`summary_prompt`, :func:`summary_response`, :func:`complete` with
  :func:`replay_completer`, :func:`batch_completer`, :func:`lead_completer`,
  :func:`extractive_completer`, :func:`keyword_completer`
* agent: :class:`ToolRegistry`, :class:`Tool`, :func:`table_tool`, :func:`answer_requests`, :func:`session_turns`
* metrics: :func:`stored_sketches`, :func:`merged_sketches`
* session: :func:`build_session`
"""

from .functions.text import byte_prefix, clean_lines, validate_content, word_count, ws_trim
from .operators.agent import Tool, ToolRegistry, session_turns
from .operators.completers import (
    batch_completer,
    complete,
    extractive_completer,
    keyword_completer,
    lead_completer,
    replay_completer,
)
from .operators.asof import asof_join
from .operators.pages import extract_batch, extract_batch_as_of, extract_pages, scrape_urls, scrape_urls_as_of, tool_response, tool_response_full
from .operators.sketches import merged_sketches, stored_sketches
from .operators.snapshots import snapshot_difference
from .operators.summarize import summary_prompt, summary_response, summary_with_keywords
from .operators.table_tools import table_tool
from .plans.answer import answer_requests, default_registry
from .session import build_session

__all__ = [
    "Tool", "ToolRegistry", "answer_requests", "asof_join", "batch_completer", "build_session", "byte_prefix",
    "clean_lines", "complete", "default_registry", "extract_batch", "extract_batch_as_of", "extract_pages", "extractive_completer",
    "keyword_completer", "lead_completer", "merged_sketches", "replay_completer", "scrape_urls", "scrape_urls_as_of", "session_turns",
    "snapshot_difference", "stored_sketches", "summary_prompt", "summary_response", "summary_with_keywords", "table_tool",
    "tool_response", "tool_response_full", "validate_content", "word_count", "ws_trim",
]
