"""Page extraction (FIXTURES F1) and URL resolution."""

from webtext.functions.extract import extract
from webtext.functions.urls import resolve

B = "https://e.org/d/p?q=1#f"
LONG = "L" * 120


def H(body, head="<title>  A &amp; B </title>"):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def test_title():
    assert extract(B, H("<p>x</p>"), None)["title"] == "A & B"
    assert extract(B, "<p>x</p>", None)["title"] == ""


def test_meta():
    html = ('<meta name="a" content="1"><meta property="og:t" content="2"><meta name="a" content="3">'
            '<meta name="x" content=""><meta charset="utf-8">')
    assert extract(B, html, None)["metadata"] == {"a": "3", "og:t": "2"}
    assert extract(B, '<meta name="n" property="p" content="v">', None)["metadata"] == {"n": "v", "p": "v"}


def test_links():
    body = ('<a href="x"><a href="/y?z=1"><a href="//cdn.org/z"><a href="https://o.org/">'
            '<a href="#top"><a href=""><a name="n"><a href="x">')
    assert extract(B, H(body), None)["links"] == [
        "https://e.org/d/x", "https://e.org/y?z=1", "https://cdn.org/z", "https://o.org/", "", "https://e.org/d/x",
    ]
    assert extract(B, H('<a href="/für,">'), None)["links"] == ["https://e.org/f%C3%BCr,"]


def test_images_and_base():
    assert extract(B, H('<img src="i.png"><img src=""><img alt="a">'), None)["images"] == ["https://e.org/d/i.png"]
    html = '<html><head><base href="https://b.org/x/"></head><body><a href="y">y</a></body></html>'
    assert extract(B, html, None)["links"] == ["https://b.org/x/y"]


def test_custom_selector():
    r = extract(B, H('<p class="a x"> hi </p><p class="x">yo</p>'), ".x")
    assert r["content"] == "hi yo" and r["selector_used"]
    assert extract(B, H('<div class="x">a\n\n  b</div>'), ".x")["content"] == "a\n\n  b"
    miss = extract(B, H(f"<article>{LONG}</article>"), ".none")
    assert miss["content"] == "" and miss["matched_selector"] is None
    assert extract(B, H("<p>x</p>"), "p:nth-child(2)")["error"] == "unsupported selector: p:nth-child(2)"
    assert extract(B, H("<div><p>a</p></div><p>b</p>"), "div > p")["content"] == "a"
    assert extract(B, H('<div id="m"><span>a</span></div><span>b</span>'), "#m span, p")["content"] == "a"


def test_main_content_order_and_threshold():
    assert extract(B, H(f"<main>{LONG}</main><article>{'A' * 120}</article>"), None)["matched_selector"] == "main"
    r = extract(B, H(f"<main>{'m' * 20}</main><article>{LONG}</article>"), None)
    assert r["matched_selector"] == "article" and r["content"] == LONG
    assert extract(B, H("<article>" + "é" * 60 + "</article>"), None)["matched_selector"] == "article"
    assert extract(B, H("<article>" + "a" * 100 + "</article>"), None)["matched_selector"] == "body"
    assert extract(B, H("<article>" + "a" * 101 + "</article>"), None)["matched_selector"] == "article"
    two = extract(B, H("<article>" + "a" * 60 + "</article><article>" + "b" * 60 + "</article>"), None)
    assert two["matched_selector"] == "article" and two["content"] == "a" * 60 + "b" * 60
    for body, sel in [
        (f'<div role="main">{LONG}</div>', "[role=main]"),
        (f'<div class="a post-content b">{LONG}</div>', ".post-content"),
        (f'<div id="content">{LONG}</div>', "#content"),
    ]:
        assert extract(B, H(body), None)["matched_selector"] == sel
    assert extract(B, H(f"<main>{LONG}<script>var q</script></main>"), None)["content"].endswith("var q")


def test_body_fallback():
    body = ('<nav>N</nav><div class="ad">AD</div><div class="sidebar">S</div><p>T</p>'
            "<script>J</script><footer>F</footer>")
    r = extract(B, H(body), None)
    assert r["matched_selector"] == "body" and r["content"] == "ADT"
    assert extract(B, "<html><body>\n  a \n\n b\n</body></html>", None)["content"] == "\n  a \n\n b\n"


def test_malformed():
    r = extract(B, H(f"<article><p><b>x{LONG}<br><p>y</article><footer>f</footer>"), None)
    assert r["content"].endswith("y") and "f" not in r["content"][-3:]
    raw = extract(B, H('<script>var t="</p>";</script><article>' + LONG + "</article>"), None)
    assert raw["content"] == LONG


def test_non_html_content_type():
    r = extract(B, H(f"<article>{LONG}</article>"), None, "application/pdf")
    assert r["content"] == "" and r["links"] == [] and r["title"] == ""


def test_resolve():
    assert resolve("https://E.org:443/a/b", "../c") == "https://e.org/c"
    assert resolve("https://e.org/a", "mailto:x@y") == "mailto:x@y"
    assert resolve("https://e.org/a", "/p q") == "https://e.org/p%20q"
    assert resolve("https://e.org/a", "?x=1#f") == "https://e.org/a?x=1"
    assert resolve("https://e.org/a?b", "?") == "https://e.org/a?"
    assert resolve("https://e.org/a?b", "?c") == "https://e.org/a?c"


def test_attribute_entities_follow_the_attribute_rule():
    html = '<a href="/x?a=1&region=us&copy=2&amp;b=3&not">x</a><img src="/i?w=1&amp;h=2">'
    r = extract(B, html, None)
    assert r["links"] == ["https://e.org/x?a=1&region=us&copy=2&b=3%C2%AC"]
    assert r["images"] == ["https://e.org/i?w=1&h=2"]


def test_resolve_fast_path_equals_general_path():
    import re

    import webtext.functions.urls as U

    cases = [("https://E.org:443/a/b?x#y", "/p q?r s"), ("https://e.org/a", "/für,?ä=1"), ("http://e.org:8080/x", "/y%zz%41"),
             ("https://e.org/", "/a'b\"c<d>`{}"), ("https://e.org/", "/a?b'c"), ("https://e.org/", "/"), ("https://e.org/", "/q?")]
    fast = [U.resolve(b, r) for b, r in cases]
    saved = U._PLAIN_ROOT
    U._PLAIN_ROOT = re.compile(r"(?!)")
    try:
        slow = [U.resolve(b, r) for b, r in cases]
    finally:
        U._PLAIN_ROOT = saved
    assert fast == slow
    assert fast[-1] == "https://e.org/q?"


def test_formatting_elements_reopen_across_blocks():
    from webtext.functions.html_tree import Selector, parse_html

    def sel(html, s):
        d = parse_html(html)
        return d.selection_text(d.select(Selector(s)))

    page = "<article><p><b>bold<br><p>next</p></article><footer>f</footer>"
    assert sel(page, "b") == "boldnextf"          # the unclosed <b> is reopened in each block
    assert sel(page, "article") == "boldnext"     # containers keep their text
    assert sel("<a href=x>1<a href=y>2</a>3", "a") == "12"
    assert sel("<table><tr><td><b>x</td><td>y</td></tr></table>z", "b") == "x"
    assert extract(B, H(page), None)["matched_selector"] == "body"  # article is under 100 bytes
