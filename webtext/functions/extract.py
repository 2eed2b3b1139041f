"""Per-page extraction: one parsed tree -> the fields of a page record.

Called once per row from the ``mapInPandas`` function of
:func:`webtext.operators.pages.extract_pages`. ``clean_text`` is *not*
computed here: it is a Catalyst expression applied after the Python step.
"""

from __future__ import annotations

from .html_tree import Selector, UnsupportedSelector, parse_html
from .text import py_trim
from .urls import resolve

# Main-content selectors, tried in this order; the first whose
# trimmed text is longer than 100 UTF-8 bytes wins.
MAIN_SELECTORS = [
    "main",
    "article",
    "[role=main]",
    ".content",
    ".post-content",
    ".entry-content",
    ".article-content",
    "#content",
    ".main-content",
]
MIN_MAIN_BYTES = 100

# Elements removed from <body> before the fallback text is taken.
EXCLUDE_SELECTORS = [
    "nav", "header", "footer", "aside", ".sidebar", "#sidebar",
    ".menu", ".navigation", ".breadcrumb", ".social", ".share",
    "script", "style", "noscript",
]

_MAIN = [Selector(s) for s in MAIN_SELECTORS]
_EXCLUDE = Selector(", ".join(EXCLUDE_SELECTORS))
_TITLE = Selector("title")
_BASE = Selector("base[href]")
_selector_cache: dict[str, Selector | UnsupportedSelector] = {}


def _selector(text: str) -> Selector:
    hit = _selector_cache.get(text)
    if hit is None:
        try:
            hit = Selector(text)
        except UnsupportedSelector as e:
            hit = e
        if len(_selector_cache) < 10000:
            _selector_cache[text] = hit
    if isinstance(hit, UnsupportedSelector):
        raise hit
    return hit


def is_html(content_type: str | None) -> bool:
    """HTML and XHTML responses are parsed; an unknown type counts as HTML."""
    if content_type is None:
        return True
    ct = content_type.lower()
    return "html" in ct


def empty_record() -> dict:
    return {
        "title": "", "content": "", "links": [], "images": [],
        "metadata": {}, "matched_selector": None, "selector_used": False, "error": None,
    }


def extract(url: str, markup: str | None, selector: str | None, content_type: str | None = None) -> dict:
    rec = empty_record()
    if markup is None or not is_html(content_type):
        return rec
    custom = None
    if selector:
        try:
            custom = _selector(selector)
        except UnsupportedSelector:
            rec["error"] = "unsupported selector: " + selector
            return rec
    doc = parse_html(markup)
    rec["title"] = py_trim(doc.selection_text(doc.select(_TITLE)))

    meta: dict[str, str] = {}
    links: list[str] = []
    images: list[str] = []
    base_el = doc.select(_BASE)
    base = resolve(url, base_el[0].attrs["href"]) if base_el else ""
    base = base or url
    for el in doc.elements:
        tag = el.tag
        if tag == "meta":
            content = el.attrs.get("content", "")
            name, prop = el.attrs.get("name", ""), el.attrs.get("property", "")
            if name and content:
                meta[name] = content
            if prop and content:
                meta[prop] = content
        elif tag == "a" and el.attrs.get("href"):
            links.append(resolve(base, el.attrs["href"]))
        elif tag == "img" and el.attrs.get("src"):
            images.append(resolve(base, el.attrs["src"]))
    rec["metadata"], rec["links"], rec["images"] = meta, links, images

    if custom is not None:
        rec["content"] = py_trim(doc.selection_text(doc.select(custom)))
        rec["selector_used"] = True
        return rec
    for text, sel in zip(MAIN_SELECTORS, _MAIN):
        content = py_trim(doc.selection_text(doc.select(sel)))
        if content and len(content.encode("utf-8")) > MIN_MAIN_BYTES:
            rec["content"], rec["matched_selector"] = content, text
            return rec
    body = doc.first("body")
    removed = doc.select(_EXCLUDE, within=body)
    rec["content"] = doc.text_without(body, removed)
    rec["matched_selector"] = "body"
    return rec


