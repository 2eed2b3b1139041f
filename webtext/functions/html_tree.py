"""Per-row HTML helper: a small HTML5-style element tree and a CSS selector subset.

Used only inside the page extractor's ``mapInPandas`` function, one page at a
time. The tree keeps every text node in one list in document order and gives
each element the half-open range of text nodes it contains, so the text of any
element (or of a whole selection) is a slice join.

Tree building follows the HTML5 rules that decide *which text ends up inside
which element*: void elements, raw-text elements (script, style, noscript, ...),
escapable raw text (title, textarea), implied ``</p>``, ``</li>``, ``</dd>``,
``</td>``, ``</option>``, end tags closing up to the matching open element,
end tags without an open element ignored, an implied ``<body>``, CR/LF
normalisation, entity decoding, and the reopening of formatting elements left
open across blocks (``<p><b>x<p>y`` puts ``y`` in a second ``<b>``). End tags
of formatting elements use a simplified adoption agency (close if open).
Not modelled: table foster parenting.
"""

from __future__ import annotations

import html as _html
import re
from html.entities import html5 as _ENTITIES
from html.parser import HTMLParser

try:  # the standard parser's own attribute / tag-name patterns
    from html.parser import attrfind_tolerant as _ATTR, tagfind_tolerant as _TAGNAME
except ImportError:  # pragma: no cover - other Python versions
    _ATTR = _TAGNAME = None

# HTML element classes from the HTML5 parsing rules.
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr image img input keygen link "
    "meta param source track wbr".split()
)
RAW_TEXT = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main "
    "menu nav ol p plaintext pre search section summary table ul li dd dt".split()
)
SCOPE_FENCE = frozenset("applet caption html table td th marquee object template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKER_TAGS = frozenset("applet caption marquee object td th template".split())
# start tags that do not reconstruct open formatting elements before they are inserted
NO_RECONSTRUCT = CLOSES_P | frozenset(
    "table hr form textarea plaintext caption col colgroup tbody td tfoot th thead tr "
    "frameset head body html script style title meta link base template noscript noframes".split()
)
_MARKER = object()
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ASCII_WS = " \t\n\f\r"
_URL_ATTR_TAGS = frozenset("a img base".split())
_CHARREF = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def attr_unescape(value: str) -> str:
    """Character references in an attribute value, HTML5 style: a legacy
    entity without ``;`` stays literal when ``=`` or an ASCII letter/digit
    follows it (``?a=1&region=us`` keeps ``&region``)."""

    def repl(m: re.Match) -> str:
        ref = m.group(1)
        if ref.startswith("#") or ref.endswith(";"):
            return _html.unescape(m.group(0))
        for n in range(len(ref), 1, -1):
            name = ref[:n]
            if name in _ENTITIES:  # names without ';' are the legacy ones
                nxt = ref[n : n + 1]
                if nxt and (nxt == "=" or (nxt.isascii() and nxt.isalnum())):
                    return m.group(0)
                return _ENTITIES[name] + ref[n:]
        return m.group(0)

    return _CHARREF.sub(repl, value)


def _raw_attrs(start_tag: str) -> dict:
    """Attributes re-read from the raw start tag with :func:`attr_unescape`."""
    out: dict = {}
    m = _TAGNAME.match(start_tag, 1)
    k = m.end()
    while k < len(start_tag):
        m = _ATTR.match(start_tag, k)
        if not m or m.end() == k:
            break
        name, rest, value = m.group(1, 2, 3)
        if not rest:
            value = ""
        elif value[:1] == "'" == value[-1:] or value[:1] == '"' == value[-1:]:
            value = value[1:-1]
        name = name.lower()
        if name not in out:
            out[name] = attr_unescape(value) if value else ""
        k = m.end()
    return out


class Element:
    __slots__ = ("tag", "attrs", "parent", "t0", "t1", "classes", "idx")

    def __init__(self, tag: str, attrs: dict, parent: "Element | None", t0: int, idx: int = 0):
        self.idx = idx
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.t0 = t0
        self.t1 = -1
        self.classes = attrs.get("class", "").split() if "class" in attrs else ()


class Document:
    """Elements in document order plus the text nodes they cover."""

    def __init__(self, elements: list[Element], texts: list[str]):
        self.elements = elements
        self.texts = texts
        self._by_tag: dict | None = None

    def _index(self) -> None:
        by_tag: dict = {}
        by_class: dict = {}
        by_id: dict = {}
        for el in self.elements:
            by_tag.setdefault(el.tag, []).append(el)
            for c in el.classes:
                by_class.setdefault(c, []).append(el)
            if "id" in el.attrs:
                by_id.setdefault(el.attrs["id"], []).append(el)
        self._by_tag, self._by_class, self._by_id = by_tag, by_class, by_id

    def _candidates(self, selector: "Selector") -> list[Element]:
        """Elements that can match the rightmost compound of some group, in document order."""
        if self._by_tag is None:
            self._index()
        out: dict = {}
        for chain in selector.groups:
            comp = chain[-1][1]
            if comp.id is not None:
                found = self._by_id.get(comp.id, [])
            elif comp.classes:
                found = self._by_class.get(comp.classes[0], [])
            elif comp.tag is not None and comp.tag != "*":
                found = self._by_tag.get(comp.tag, [])
            else:
                return self.elements
            for el in found:
                out[el.idx] = el
        return [out[i] for i in sorted(out)]

    def text(self, el: Element) -> str:
        return "".join(self.texts[el.t0 : el.t1])

    def select(self, selector: "Selector", within: Element | None = None) -> list[Element]:
        out = []
        for el in self._candidates(selector):
            if within is not None and not _is_descendant(el, within):
                continue
            if el.tag == "html" and within is None:
                continue
            if selector.matches(el):
                out.append(el)
        return out

    def selection_text(self, els: list[Element]) -> str:
        return "".join(self.text(e) for e in els)

    def text_without(self, root: Element, removed: list[Element]) -> str:
        """Text of ``root`` with the subtrees of ``removed`` cut out."""
        keep = [True] * (root.t1 - root.t0)
        for el in removed:
            for i in range(max(el.t0, root.t0), min(el.t1, root.t1)):
                keep[i - root.t0] = False
        return "".join(t for t, k in zip(self.texts[root.t0 : root.t1], keep) if k)

    def first(self, tag: str) -> Element | None:
        for el in self.elements:
            if el.tag == tag:
                return el
        return None


def _is_descendant(el: Element, anc: Element) -> bool:
    p = el.parent
    while p is not None:
        if p is anc:
            return True
        p = p.parent
    return False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.stack: list[Element] = []
        self.html_el: Element | None = None
        self.head_el: Element | None = None
        self.body_el: Element | None = None
        self.mode = "before_head"
        self.raw_tag: str | None = None
        self.drop_lf = False
        self.open_ids: set[int] = set()
        self.active: list = []  # active formatting elements and markers

    # -- tree helpers -------------------------------------------------
    def _open(self, tag: str, attrs: dict) -> Element:
        parent = self.stack[-1] if self.stack else None
        el = Element(tag, attrs, parent, len(self.texts), len(self.elements))
        self.elements.append(el)
        self.stack.append(el)
        self.open_ids.add(id(el))
        return el

    def _pop(self) -> Element:
        el = self.stack.pop()
        el.t1 = len(self.texts)
        self.open_ids.discard(id(el))
        if el.tag in MARKER_TAGS:
            self._clear_to_marker()
        return el

    # -- active formatting elements (HTML5 "reconstruct" rule) --------------
    def _clear_to_marker(self) -> None:
        while self.active:
            if self.active.pop() is _MARKER:
                return

    def _active_after_marker(self, tag: str):
        for e in reversed(self.active):
            if e is _MARKER:
                return None
            if e.tag == tag:
                return e
        return None

    def _push_active(self, el: Element) -> None:
        same = [i for i in range(len(self.active) - 1, -1, -1) if self.active[i] is not _MARKER
                and self.active[i].tag == el.tag and self.active[i].attrs == el.attrs]
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is _MARKER:
                same = [j for j in same if j > i]
                break
        if len(same) >= 3:
            del self.active[min(same)]
        self.active.append(el)

    def _reconstruct(self) -> None:
        """Reopen formatting elements that were closed implicitly (for example a
        ``<b>`` left open across paragraphs), as HTML parsers do."""
        act = self.active
        if not act or act[-1] is _MARKER or id(act[-1]) in self.open_ids:
            return
        i = len(act) - 1
        while i > 0 and act[i - 1] is not _MARKER and id(act[i - 1]) not in self.open_ids:
            i -= 1
        for j in range(i, len(act)):
            act[j] = self._open(act[j].tag, dict(act[j].attrs))

    def _pop_until(self, el: Element) -> None:
        while self.stack:
            if self._pop() is el:
                return

    def _ensure_html(self) -> None:
        if self.html_el is None:
            self.html_el = self._open("html", {})

    def _ensure_body(self) -> None:
        self._ensure_html()
        if self.body_el is None:
            if self.head_el is not None and self.head_el in self.stack:
                self._pop_until(self.head_el)
            self.body_el = self._open("body", {})
        self.mode = "in_body"

    def _in_scope(self, tags, fence=SCOPE_FENCE) -> Element | None:
        for el in reversed(self.stack):
            if el.tag in tags:
                return el
            if el.tag in fence:
                return None
        return None

    def _in_foreign(self) -> bool:
        return any(el.tag in ("svg", "math") for el in self.stack)

    # -- parser callbacks ---------------------------------------------
    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self._in_foreign() and self.stack and self.stack[-1].tag == tag:
            self._pop()

    def handle_starttag(self, tag, attrs):
        self.drop_lf = False
        a: dict = {}
        for k, v in attrs:
            if k not in a:
                a[k] = "" if v is None else v
        raw = self.get_starttag_text()
        if tag in _URL_ATTR_TAGS and _ATTR is not None and raw and "&" in raw:
            a = _raw_attrs(raw)
        if tag == "image":
            tag = "img"
        if tag == "html":
            self._ensure_html()
            return
        self._ensure_html()
        if self.mode != "in_body":
            if tag == "head" and self.head_el is None:
                self.head_el = self._open("head", a)
                self.mode = "in_head"
                return
            if tag in HEAD_ONLY and self.body_el is None:
                if self.head_el is None:
                    self.head_el = self._open("head", {})
                    self.mode = "in_head"
                self._insert(tag, a)
                return
            if tag == "body":
                if self.head_el is not None and self.head_el in self.stack:
                    self._pop_until(self.head_el)
                if self.body_el is None:
                    self.body_el = self._open("body", a)
                self.mode = "in_body"
                return
            self._ensure_body()
        if tag in ("head", "body", "html"):
            return
        if tag in CLOSES_P:
            p = self._in_scope(("p",), SCOPE_FENCE | {"button"})
            if p is not None:
                self._pop_until(p)
        if tag == "li":
            li = self._in_scope(("li",), SCOPE_FENCE | {"ol", "ul"})
            if li is not None:
                self._pop_until(li)
        elif tag in ("dd", "dt"):
            d = self._in_scope(("dd", "dt"), SCOPE_FENCE | {"dl"})
            if d is not None:
                self._pop_until(d)
        elif tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
            self._pop()
        elif tag in ("option", "optgroup") and self.stack and self.stack[-1].tag == "option":
            self._pop()
        elif tag in ("td", "th", "tr"):
            cell = self._in_scope(("td", "th"), {"table", "html"})
            if cell is not None:
                self._pop_until(cell)
            if tag == "tr":
                row = self._in_scope(("tr",), {"table", "html"})
                if row is not None:
                    self._pop_until(row)
        elif tag == "a":
            prev = self._active_after_marker("a")
            if prev is not None:
                self._end_formatting(prev)
        if tag not in NO_RECONSTRUCT:
            self._reconstruct()
        self._insert(tag, a)
        if tag in FORMATTING:
            self._push_active(self.stack[-1])
        elif tag in ("applet", "marquee", "object", "template", "td", "th", "caption"):
            self.active.append(_MARKER)

    def _insert(self, tag: str, a: dict) -> None:
        self._open(tag, a)
        if tag in VOID:
            self._pop()
        elif tag in RAW_TEXT or tag in ESCAPABLE_RAW:
            self.raw_tag = tag
            self.set_cdata_mode(tag)
        elif tag in ("pre", "listing", "textarea"):
            self.drop_lf = True

    def handle_endtag(self, tag):
        self.drop_lf = False
        if self.raw_tag is not None and tag == self.raw_tag:
            self.raw_tag = None
            if self.stack and self.stack[-1].tag == tag:
                self._pop()
            return
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head_el is not None and self.head_el in self.stack:
                self._pop_until(self.head_el)
                self.mode = "after_head"
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if self.mode != "in_body" and tag not in HEAD_ONLY:
            return
        if tag in FORMATTING:
            fe = self._active_after_marker(tag)
            if fe is not None:
                self._end_formatting(fe)
                return
        target = self._in_scope((tag,))
        if target is not None and target is not self.html_el:
            self._pop_until(target)

    def _end_formatting(self, fe: Element) -> None:
        """End tag of an active formatting element (simplified adoption agency):
        close it if it is still open, and stop reopening it."""
        self.active.remove(fe)
        if id(fe) in self.open_ids:
            self._pop_until(fe)

    def handle_data(self, data):
        if not data:
            return
        data = data.replace("\x00", "")
        if self.raw_tag in ESCAPABLE_RAW:
            data = _html.unescape(data)
        if self.drop_lf:
            self.drop_lf = False
            if data.startswith("\n"):
                data = data[1:]
        if self.raw_tag is None and self.mode != "in_body":
            rest = data.lstrip(_ASCII_WS)
            if not rest:
                return
            self._ensure_body()
            data = rest
        self._ensure_html()
        if data:
            if self.raw_tag is None:
                self._reconstruct()
            self.texts.append(data)

    def finish(self) -> Document:
        self.close()
        self._ensure_html()
        if self.body_el is None:
            self._ensure_body()
        while self.stack:
            self._pop()
        return Document(self.elements, self.texts)


def parse_html(markup: str) -> Document:
    b = _Builder()
    b.feed(markup.replace("\r\n", "\n").replace("\r", "\n"))
    return b.finish()


# -- selectors -----------------------------------------------------------

_TOKEN = re.compile(
    r"""(?:
        (?P<comb>>)|
        (?P<tag>\*|[A-Za-z][A-Za-z0-9_-]*)|
        \.(?P<cls>-?[A-Za-z_][A-Za-z0-9_-]*)|
        \#(?P<id>-?[A-Za-z0-9_][A-Za-z0-9_-]*)|
        \[\s*(?P<attr>[A-Za-z_:][A-Za-z0-9_:.-]*)\s*
            (?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[A-Za-z0-9_-]+))\s*)?\]|
        (?P<ws>\s+)
    )""",
    re.X,
)


class UnsupportedSelector(ValueError):
    pass


class _Compound:
    __slots__ = ("tag", "classes", "id", "attrs")

    def __init__(self):
        self.tag = None
        self.classes: list[str] = []
        self.id = None
        self.attrs: list[tuple[str, str | None, str | None]] = []

    def empty(self) -> bool:
        return self.tag is None and not self.classes and self.id is None and not self.attrs

    def matches(self, el: Element) -> bool:
        if self.tag is not None and self.tag != "*" and el.tag != self.tag:
            return False
        if self.id is not None and el.attrs.get("id") != self.id:
            return False
        for c in self.classes:
            if c not in el.classes:
                return False
        for name, op, val in self.attrs:
            if name not in el.attrs:
                return False
            v = el.attrs[name]
            if op is None:
                continue
            if op == "=" and v != val:
                return False
            if op == "~=" and val not in v.split():
                return False
            if op == "^=" and not (val and v.startswith(val)):
                return False
            if op == "$=" and not (val and v.endswith(val)):
                return False
            if op == "*=" and not (val and val in v):
                return False
            if op == "|=" and not (v == val or v.startswith(val + "-")):
                return False
        return True


class Selector:
    """Comma list of chains of compound selectors joined by descendant / child."""

    def __init__(self, text: str):
        self.text = text
        self.groups: list[list[tuple[str, _Compound]]] = []
        for part in _split_commas(text):
            self.groups.append(_parse_chain(part, text))
        if not self.groups:
            raise UnsupportedSelector(text)

    def matches(self, el: Element) -> bool:
        return any(_match_chain(chain, len(chain) - 1, el) for chain in self.groups)


def _split_commas(text: str) -> list[str]:
    parts, depth, cur = [], 0, []
    for ch in text:
        if ch == "[":
            depth += 1
        elif ch == "]":
            depth -= 1
        if ch == "," and depth == 0:
            parts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    parts.append("".join(cur))
    return [p.strip() for p in parts]


def _parse_chain(part: str, whole: str) -> list[tuple[str, _Compound]]:
    if not part:
        raise UnsupportedSelector(whole)
    chain: list[tuple[str, _Compound]] = []
    comb, cur, pos = " ", _Compound(), 0
    pending_ws = False
    while pos < len(part):
        m = _TOKEN.match(part, pos)
        if not m or m.end() == pos:
            raise UnsupportedSelector(whole)
        pos = m.end()
        if m.group("ws") is not None:
            pending_ws = True
            continue
        if m.group("comb"):
            if cur.empty():
                raise UnsupportedSelector(whole)
            chain.append((comb, cur))
            comb, cur, pending_ws = ">", _Compound(), False
            continue
        if pending_ws and not cur.empty():
            chain.append((comb, cur))
            comb, cur = " ", _Compound()
        pending_ws = False
        if m.group("tag"):
            if not cur.empty():
                raise UnsupportedSelector(whole)
            cur.tag = m.group("tag").lower()
        elif m.group("cls"):
            cur.classes.append(m.group("cls"))
        elif m.group("id"):
            cur.id = m.group("id")
        else:
            val = next((m.group(g) for g in ("dq", "sq", "bare") if m.group(g) is not None), None)
            cur.attrs.append((m.group("attr").lower(), m.group("op"), val))
    if cur.empty():
        raise UnsupportedSelector(whole)
    chain.append((comb, cur))
    return chain


def _match_chain(chain, i: int, el: Element) -> bool:
    comb, comp = chain[i]
    if not comp.matches(el):
        return False
    if i == 0:
        return True
    if comb == ">":
        return el.parent is not None and _match_chain(chain, i - 1, el.parent)
    p = el.parent
    while p is not None:
        if _match_chain(chain, i - 1, p):
            return True
        p = p.parent
    return False
