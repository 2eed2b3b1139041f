"""Inputs derived from the driver tables by fixed rules.

The driver tables hold no exits, no model answers, no tool calls and no URL
batches, so operators that need them get inputs computed from the tables by
simple rules that a SQL engine can recompute identically. All of it is Spark
work over the whole tables (no row caps or id subsets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

MISSING_HOST = "https://missing.example/"


def padded_documents(docs: DataFrame) -> DataFrame:
    """Documents with NBSP + space before and an empty line + tab after every LF."""
    return docs.select(
        "doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\u00a0 \n\n\t")).alias("text")
    )


def pages_with_media(pages: DataFrame) -> DataFrame:
    """Pages with meta tags and images injected (the driver pages have none):
    after ``<meta charset="utf-8">`` a ``name="k<id % 3>"`` tag, a
    ``property="og:t"`` tag and the same name again with another value (the
    later one must win); after ``<article>`` a root-relative image, a relative
    image and an image without ``src``."""
    pid = F.col("page_id").cast("string")
    k = (F.col("page_id") % 3).cast("string")
    metas = F.concat(
        F.lit('<meta charset="utf-8"><meta name="k'), k, F.lit('" content="v'), pid,
        F.lit('"><meta property="og:t" content="p'), (F.col("page_id") % 5).cast("string"),
        F.lit('"><meta name="k'), k, F.lit('" content="w'), pid, F.lit('">'),
    )
    imgs = F.concat(F.lit('<article><img src="/i/'), pid, F.lit('.png"><img src="rel.jpg"><img alt="x">'))
    html = F.replace(F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), metas), F.lit("<article>"), imgs)
    return pages.withColumn("html", html)


def summary_style() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ["", "concise", "detailed", "bullet_points", "haiku"]]), (F.col("doc_id") % 5 + 1).cast("int"))


def summary_requests(docs: DataFrame) -> DataFrame:
    """One summary request per document: max_length 0/50/100/150 by ``doc_id % 4``,
    style ''/concise/detailed/bullet_points/haiku by ``doc_id % 5``, language
    = the document's language unless ``doc_id % 3 = 0``."""
    return docs.select(
        F.col("doc_id").alias("request_id"),
        F.col("text").alias("content"),
        ((F.col("doc_id") % 4) * 50).cast("int").alias("max_length"),
        summary_style().alias("style"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")).alias("language"),
    )


def recorded_completions(docs: DataFrame) -> DataFrame:
    """Model answers as a table, two kinds per document.

    summary: ``doc_id % 10 = 0`` transport error ``boom``; ``= 1`` no choices;
    else ``'  ' || text || ' '``. keywords: ``% 10 = 2`` error,
    ``= 3`` no choices, else every different word, in order of its first place, joined by ``' , '`` plus ``',,'``.
    Model ``m<doc_id % 3>``; tokens from ``n_chars``.
    """
    m = F.col("doc_id") % 10
    base = {
        "request_id": F.col("doc_id"),
        "model": F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")),
        "prompt_tokens": (F.col("n_chars") % 97).cast("long"),
        "completion_tokens": (F.col("n_chars") % 31).cast("long"),
        "total_tokens": (F.col("n_chars") % 97 + F.col("n_chars") % 31).cast("long"),
    }

    def kind(name: str, err_rem: int, none_rem: int, content: Column) -> DataFrame:
        return docs.select(
            *[v.alias(k) for k, v in base.items()],
            F.lit(name).alias("kind"),
            F.when(m == none_rem, 0).otherwise(1).alias("n_choices"),
            F.when((m != err_rem) & (m != none_rem), content).alias("content"),
            F.when(m == err_rem, F.lit("boom")).alias("error"),
        )

    summary = kind("summary", 0, 1, F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
    kw = kind("keywords", 2, 3, F.concat(F.array_join(F.array_distinct(words(F.col("text"))), " , "), F.lit(",,")))
    return summary.unionByName(kw)


def session_lines(conversations: DataFrame) -> DataFrame:
    """User lines with exits and blanks injected: `` Exit `` when
    ``(conv_id*7 + turn*3) % 11 = 0``, tab+space when ``(conv_id + turn) % 5 = 0``."""
    c, t = F.col("conv_id"), F.col("turn")
    text = (
        F.when((c * 7 + t * 3) % 11 == 0, F.lit(" Exit "))
        .when((c + t) % 5 == 0, F.lit("\t "))
        .otherwise(F.col("text"))
    )
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def url_batches(pages: DataFrame) -> DataFrame:
    """Batches of ten pages (``page_id div 10``): urls in page_id order, then a
    missing URL, then the batch's first URL again (a duplicate)."""
    per = pages.select((F.col("page_id") / 10).cast("long").alias("batch_id"), "page_id", "url")
    grouped = per.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("_p"))
    urls = F.transform("_p", lambda p: p["url"])
    return grouped.select(
        "batch_id",
        F.concat(
            urls,
            F.array(F.concat(F.lit(MISSING_HOST), F.col("batch_id").cast("string")), F.element_at(urls, 1)),
        ).alias("urls"),
    )


def with_event_time(rows: DataFrame, events: DataFrame, number: Column, name: str) -> DataFrame:
    """``rows`` with the time ``name`` of event ``number % count(events)``; NULL where ``number`` is."""
    ts = events.select(F.col("event_id").alias("_event"), F.col("ts").alias(name))
    return rows.withColumn("_event", number % events.select(F.count(F.lit(1))).scalar()).join(ts, "_event", "left").drop("_event")


def page_responses(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Three stored responses per page, ids ``page_id * 3 + v``: fetched at event ``id * 7``, the title
    marked ``v<v> ``. The third one of every page with ``page_id % 4 = 3`` was fetched at the second one's
    time; the second one of every page with ``page_id % 5 = 0`` has status 503, all others 200."""
    versions = pages.withColumn("v", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    number = F.col("page_id") * 3 + F.col("v")
    same = (F.col("v") == 2) & (F.col("page_id") % 4 == 3)
    dated = with_event_time(versions, events, F.when(same, number - 1).otherwise(number) * 7, "fetched_at")
    return dated.select(
        number.alias("page_id"), "url", "fetched_at",
        F.replace(F.col("html"), F.lit("<title>"), F.concat(F.lit("<title>v"), F.col("v").cast("string"), F.lit(" "))).alias("html"),
        F.when((F.col("v") == 1) & (F.col("page_id") % 5 == 0), 503).otherwise(200).alias("status_code"), "content_type",
    )


def page_snapshots(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two crawls: the first holds every page ``1 + page_id % 3`` times, the second ``page_id % 4`` times,
    with another content (a comment at the end) where ``page_id % 5 = 0``."""
    def copies(n: Column) -> Column:
        return F.explode(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array()))

    before = pages.withColumn("copy", copies(F.col("page_id") % 3 + 1))
    after = pages.withColumn("copy", copies(F.col("page_id") % 4))
    after = after.withColumn("html", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("<!-- second crawl -->"))).otherwise(F.col("html")))
    return before.drop("copy"), after.drop("copy")


def dated_items(batches: DataFrame, events: DataFrame) -> DataFrame:
    """URLs of batches (batch_id, idx, url), each requested at event ``(batch_id * 13 + idx) * 17``; no time where ``(batch_id + idx) % 11 = 0``."""
    items = batches.select("batch_id", F.posexplode("urls").alias("idx", "url"))
    b, i = F.col("batch_id"), F.col("idx")
    return with_event_time(items, events, F.when((b + i) % 11 != 0, (b * 13 + i) * 17), "requested_at")


def _call(name: str, args: list[tuple[str, Column]], reasoning: str) -> Column:
    parts: list[Column] = [F.lit('{"name":"' + name + '","arguments":{')]
    for i, (k, v) in enumerate(args):
        parts.append(F.lit((',' if i else '') + '"' + k + '":'))
        parts.append(v)
    parts.append(F.lit('},"reasoning":"' + reasoning + '"}'))
    return F.concat(*parts)


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _decision(calls: list[Column], should: bool, conf: str, post: str, message: str = "Working on it.") -> Column:
    body: list[Column] = [F.lit('{"message":"' + message + '","tool_calls":[')]
    for i, c in enumerate(calls):
        if i:
            body.append(F.lit(","))
        body.append(c)
    body.append(
        F.lit(
            '],"should_call":' + ("true" if should else "false") + ',"confidence":' + conf
            + ',"explanation":"derived decision","post_process":"' + post + '"}'
        )
    )
    return F.concat(*body)


def request_key() -> Column:
    """The key of a request, ``<conv_id>:<turn>``: one for every turn, whatever the two numbers are."""
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))


def request_seed() -> Column:
    """A number from the key that the rules of the derived answers count by."""
    conv, turn = (F.split_part("request_id", F.lit(":"), F.lit(i)).cast("long") for i in (1, 2))
    return F.pmod(conv, F.lit(1000003)) * 1009 + F.pmod(turn, F.lit(1009))


def post_completions(requests: DataFrame) -> DataFrame:
    """Model answers to post-processing requests, by ``seed % 5``: 1 a
    transport error, 2 no choices, else `` Done: <user text> ``."""
    m = request_seed() % 5
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    return requests.select(
        "request_id",
        F.when(m == 2, 0).otherwise(1).alias("n_choices"),
        F.when((m != 1) & (m != 2), F.concat(F.lit(" Done: "), F.col("user_text"), F.lit(" "))).alias("content"),
        none.alias("model"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"), zero.alias("total_tokens"),
        F.when(m == 1, F.lit("boom")).alias("error"),
    )


def user_requests(conversations: DataFrame) -> DataFrame:
    """User turns as requests with the key ``<conv_id>:<turn>``."""
    return conversations.filter(F.col("role") == "user").select(
        request_key().alias("request_id"), "conv_id", "turn", F.col("text").alias("user_text")
    )


def decisions(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Model answers to analysis requests, as a completions table, by
    ``k = seed % 23`` of the key's :func:`request_seed` (FIXTURES §3); ``page(i)`` = url of ``page_id = i % count(pages)``.

    0-8 calls of the page tool; 9 should_call false, confidence 0.5; 10 no
    calls; 11 JSON null; 12 repeated keys; 13 oddly cased keys; 14 null fields;
    15-18 calls of the document tool, of which 16-18 with faults; 19 a
    transport error; 20 no choices; 21 no row at all; 22 both tools.
    """
    n_pages = pages.select(F.count(F.lit(1))).scalar()  # scalar subquery, one value
    p = pages.select("page_id", "url")
    r = requests.select("request_id", n_pages.alias("n_pages"))
    r = (
        r.join(p.withColumnsRenamed({"page_id": "_p1", "url": "url1"}), F.col("_p1") == request_seed() % F.col("n_pages"), "left")
        .join(p.withColumnsRenamed({"page_id": "_p2", "url": "url2"}), F.col("_p2") == (request_seed() + 1) % F.col("n_pages"), "left")
    )
    rid = F.col("request_id").cast("string")
    u1, u2 = _q(F.col("url1")), _q(F.col("url2"))
    doc = (request_seed() % F.col("n_pages")).cast("string")
    scrape1 = _call("scrape_url", [("url", u1)], "page requested")

    def read(doc_id: Column | None, min_chars: str, with_source: str) -> Column:
        own = [("doc_id", doc_id)] if doc_id is not None else []
        return _call("read_document", [*own, ("min_chars", F.lit(min_chars)), ("with_source", F.lit(with_source))], "document requested")

    missing = _call("scrape_url", [("url", _q(F.concat(F.lit(MISSING_HOST), rid))), ("selector", F.lit('"article"'))], "missing page")
    valid = _decision([scrape1], True, "0.9", "")
    texts = [
        valid,
        _decision([scrape1, _call("scrape_url", [("url", u2)], "second page")], True, "0.8", "Summarize"),
        _decision([_call("fetch_page", [("url", u1)], "fetch")], True, "0.7", ""),
        _decision([_call("scrape_url", [("selector", F.lit('"article"'))], "no url")], True, "0.6", ""),
        _decision([_call("scrape_url", [("url", F.lit("42"))], "numeric url")], True, "0.6", ""),
        _decision([scrape1], True, "0.3", ""),
        F.concat(F.lit("```json\n"), valid, F.lit("\n```")),
        F.concat(valid, F.lit(" Let me know if you need more.")),
        _decision([missing], True, "0.9", ""),
        _decision([scrape1], False, "0.5", ""),
        _decision([], True, "0.1225", ""),
        F.lit("null"),
        F.concat(F.lit('{"message":"first","confidence":0.9,"tool_calls":['), scrape1, F.lit('],"message":"second","should_call":true,"confidence":0.2345}')),
        F.concat(F.lit('{"MESSAGE":"cased","Tool_Calls":['), scrape1, F.lit('],"Should_Call":true,"CONFIDENCE":0.3555,"Explanation":"derived decision"}')),
        F.lit('{"message":null,"tool_calls":null,"should_call":true,"confidence":null,"explanation":null,"post_process":null}'),
        _decision([read(doc, "100.5", "true")], True, "0.9", "Summarize"),
        _decision([read(_q(doc), "1", "false")], True, "0.9", ""),
        _decision([read(doc, '"many"', "false")], True, "0.9", ""),
        _decision([read(None, "1", "1")], True, "0.9", ""),
        None, None, None,
        _decision([scrape1, read(doc, "0", "false"), missing], True, "0.9", "Recommend topic"),
    ]
    k = request_seed() % len(texts)
    text = F.when(F.lit(False), F.lit(""))
    for i, t in enumerate(texts):
        if t is not None:
            text = text.when(k == i, t)
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    return r.where(k != 21).select(
        "request_id",
        F.when(k == 20, 0).otherwise(1).alias("n_choices"),
        text.alias("content"),
        none.alias("model"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"), zero.alias("total_tokens"),
        F.when(k == 19, F.lit("boom")).alias("error"),
    )


def counting_calls(requests: DataFrame) -> DataFrame:
    """A call of the word counting tool per request: its text, and ``least`` = 1 + seed % 2 where seed % 3 > 0."""
    least = F.when(request_seed() % 3 > 0, (1 + request_seed() % 2).cast("string"))
    entry = "struct<kind:string,text:string>"
    args = F.map_from_arrays(
        F.when(least.isNotNull(), F.array(F.lit("text"), F.lit("least"))).otherwise(F.array(F.lit("text"))),
        F.when(least.isNotNull(), F.array(F.struct(F.lit("string").alias("kind"), F.col("user_text").alias("text")), F.struct(F.lit("number").alias("kind"), least.alias("text")))).otherwise(
            F.array(F.struct(F.lit("string").alias("kind"), F.col("user_text").alias("text")))))
    return requests.select("request_id", F.lit(1).alias("call_idx"), F.lit("count_words").alias("name"), args.cast(f"map<string,{entry}>").alias("arguments"))
