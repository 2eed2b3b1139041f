"""Resolve a link against its page URL the way a WHATWG URL parser serialises it.

Per-row helper used inside the page extractor: relative / root-relative /
protocol-relative references, dot segments, lower-case host, IDNA for
non-ASCII hosts, default ports dropped, non-ASCII and unsafe characters
percent-encoded, fragment dropped. A fragment-only reference resolves to ``""``.
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import SplitResult, urljoin, urlsplit, urlunsplit

SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_STRIP = "".join(chr(i) for i in range(0x21))
_TABNL = re.compile("[\t\n\r]")
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_PCT = re.compile(r"%(?![0-9A-Fa-f]{2})")

# Characters percent-encoded in the path / query of special URLs
# besides C0 controls, space and everything above U+007E.
_PATH_EXTRA = set('"#<>?`{}')
_QUERY_EXTRA = set("\"#<>'")


def _encode(text: str, extra: set[str]) -> str:
    out = []
    for ch in text:
        o = ord(ch)
        if o <= 0x20 or o > 0x7E or ch in extra:
            out.append("".join("%%%02X" % b for b in ch.encode("utf-8", "surrogatepass")))
        else:
            out.append(ch)
    return _PCT.sub("%25", "".join(out))


def _host(netloc: str, scheme: str) -> str | None:
    userinfo, _, hostport = netloc.rpartition("@")
    host, port = hostport, ""
    if hostport.startswith("["):
        end = hostport.find("]")
        host, port = hostport[: end + 1], hostport[end + 2 :]
    elif ":" in hostport:
        host, _, port = hostport.rpartition(":")
    host = host.lower()
    if any(ord(c) > 0x7E for c in host):
        try:
            host = host.encode("idna").decode("ascii")
        except UnicodeError:
            return None
    if port:
        if not port.isdigit():
            return None
        if SPECIAL.get(scheme) == int(port):
            port = ""
        else:
            port = str(int(port))
    out = (userinfo + "@" if userinfo else "") + host
    return out + (":" + port if port else "")


_PLAIN_ROOT = re.compile(r"/(?!/)[^\\#\x00-\x20]*")


@lru_cache(maxsize=4096)
def _origin(base: str) -> str | None:
    """``scheme://host[:port]`` of a special-scheme base URL, as serialised."""
    try:
        parts = urlsplit(base)
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in SPECIAL or scheme == "file":
        return None
    host = _host(parts.netloc, scheme)
    return f"{scheme}://{host}" if host else None


def resolve(base: str, ref: str) -> str:
    """Absolute form of ``ref`` relative to ``base``; ``""`` when it cannot be made."""
    if ref.startswith("#"):
        return ""
    if _PLAIN_ROOT.fullmatch(ref) and "/." not in ref:
        # fast path: root-relative, no dot segments, fragment or white space
        origin = _origin(base)
        if origin is not None:
            path, q, query = ref.partition("?")
            return origin + _encode(path, _PATH_EXTRA) + (("?" + _encode(query, _QUERY_EXTRA)) if q else "")
    ref = _TABNL.sub("", ref.strip(_STRIP))
    m = _SCHEME.match(ref)
    ref_scheme = m.group(1).lower() if m else None
    base_scheme = (_SCHEME.match(base).group(1).lower() if _SCHEME.match(base) else "")
    if (ref_scheme or base_scheme) in SPECIAL:
        ref = ref.replace("\\", "/")
    try:
        if ref.split("#", 1)[0] == "?":
            # an empty query replaces the base's query (urljoin would keep the old one)
            joined = base.split("#", 1)[0].split("?", 1)[0] + "?"
        else:
            joined = urljoin(base, ref) if ref_scheme is None or ref_scheme in SPECIAL else ref
        parts = urlsplit(joined)
    except ValueError:
        return ""
    scheme = parts.scheme.lower()
    if scheme not in SPECIAL:
        # opaque or non-special URL: only controls and non-ASCII are encoded
        body = joined.split("#", 1)[0]
        return _encode(body, set())
    host = _host(parts.netloc, scheme)
    if host is None or (not host and scheme != "file"):
        return ""
    path = _encode(parts.path or "/", _PATH_EXTRA)
    query = _encode(parts.query, _QUERY_EXTRA)
    url = urlunsplit(SplitResult(scheme, host, path, "", ""))
    # an empty query still serialises as "?" (urljoin drops it, so look at the reference too)
    if "?" in joined.split("#", 1)[0] or "?" in ref.split("#", 1)[0]:
        url += "?" + query
    return url
