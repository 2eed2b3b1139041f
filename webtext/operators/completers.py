"""Completers: where a request's completion comes from.

A completer is ``requests -> completions``. Requests have ``request_id`` and
whatever the completer reads (``content``, ``max_length``, ``style``,
``prompt``). Completions have ``request_id, text, model, prompt_tokens,
completion_tokens, total_tokens, failure, cause, error`` where ``failure`` is
NULL on success, else ``transport`` / ``no_choices`` / ``missing`` and
``error`` is the summariser's message for it. A failed request is a row, never
a failed job.

* :func:`replay_completer` -- join recorded model answers (a ``completions`` table).
* :func:`batch_completer` -- run a user batch function over the requests (``mapInPandas``).
* :func:`lead_completer`, :func:`extractive_completer`, :func:`keyword_completer` --
  offline methods (ours). They are simpler than a model and do not reproduce its wording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count, words, ws_trim
from ..session import written_table

COMPLETION_COLS = [
    "request_id", "text", "model", "prompt_tokens", "completion_tokens",
    "total_tokens", "failure", "cause", "error",
]

# Sentences: a run of non-terminator characters plus its terminators. Terms:
# letter/digit runs of the lower-cased text. Both patterns mean the same in
# Java regex and RE2, so a SQL engine can recompute them.
SENTENCE_RE = "[^.!?\\n]+[.!?]*"
TERM_RE = "[\\p{L}\\p{N}]+"
WEIGHT_SCALE = 1000000
TOP_KEYWORDS = 10
FREQUENT = 200000  # terms whose document frequencies are copied to all tasks (about 20 MB)


def failure_message(failure: Column, cause: Column) -> Column:
    return (
        F.when(failure == "transport", F.concat(F.lit("failed to create chat completion: "), cause))
        .when(failure == "no_choices", F.lit("no response choices returned"))
        .when(failure == "missing", F.lit("no completion"))
    )


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("error", failure_message(F.col("failure"), F.col("cause"))).select(*COMPLETION_COLS)


def replay_completer(recorded: DataFrame, kind: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Recorded answers keyed by ``request_id`` (optionally filtered to one ``kind``):
    ``n_choices, content, model, prompt_tokens, completion_tokens, total_tokens, error``.
    A request without a recorded answer fails with ``missing``."""

    def run(requests: DataFrame) -> DataFrame:
        rec = recorded if kind is None else recorded.filter(F.col("kind") == kind)
        rec = rec.select(
            "request_id",
            F.col("n_choices").alias("_n"),
            F.col("content").alias("_content"),
            F.col("model").alias("_model"),
            F.col("prompt_tokens").cast("long").alias("_pt"),
            F.col("completion_tokens").cast("long").alias("_ct"),
            F.col("total_tokens").cast("long").alias("_tt"),
            F.col("error").alias("_error"),
            F.lit(True).alias("_hit"),
        )
        j = requests.select("request_id").join(rec, "request_id", "left")
        failure = (
            F.when(F.col("_hit").isNull(), F.lit("missing"))
            .when(F.col("_error").isNotNull(), F.lit("transport"))
            .when(F.coalesce(F.col("_n"), F.lit(0)) == 0, F.lit("no_choices"))
        )
        ok = failure.isNull()
        return _finish(
            j.select(
                "request_id",
                F.when(ok, F.col("_content")).alias("text"),
                F.when(ok, F.col("_model")).alias("model"),
                F.when(ok, F.col("_pt")).alias("prompt_tokens"),
                F.when(ok, F.col("_ct")).alias("completion_tokens"),
                F.when(ok, F.col("_tt")).alias("total_tokens"),
                failure.alias("failure"),
                F.col("_error").alias("cause"),
            )
        )

    return run


def batch_completer(fn: Callable, model: str) -> Callable[[DataFrame], DataFrame]:
    """Wrap a user function ``pandas.DataFrame(request_id, prompt) -> pandas.DataFrame(
    request_id, text, error)`` (e.g. a client for a hosted model) as a completer.
    It runs per Arrow batch on the executors; an exception in one batch becomes
    a ``transport`` failure for that batch's rows instead of a failed job."""

    def run(requests: DataFrame) -> DataFrame:
        def per_batch(it):
            import pandas as pd

            for pdf in it:
                try:
                    out = fn(pdf[["request_id", "prompt"]])
                    out = out[["request_id", "text", "error"]]
                except Exception as exc:  # noqa: BLE001 - failures are data here
                    out = pd.DataFrame({"request_id": pdf["request_id"], "text": None, "error": str(exc)})
                yield out

        key = requests.schema["request_id"].dataType.simpleString()
        got = requests.select("request_id", "prompt").mapInPandas(
            per_batch, f"request_id {key}, text string, error string"
        )
        failure = F.when(F.col("error").isNotNull(), F.lit("transport")).when(F.col("text").isNull(), F.lit("no_choices"))
        pt = word_count(F.col("prompt"))
        joined = requests.select("request_id", "prompt").join(got, "request_id", "left")
        return _finish(
            joined.select(
                "request_id",
                "text",
                F.lit(model).alias("model"),
                pt.alias("prompt_tokens"),
                word_count(F.col("text")).alias("completion_tokens"),
                (pt + F.coalesce(word_count(F.col("text")), F.lit(0))).alias("total_tokens"),
                failure.alias("failure"),
                F.col("error").alias("cause"),
            )
        )

    return run


def _offline(requests: DataFrame, text: Column, model: str) -> DataFrame:
    src = F.col("prompt") if "prompt" in requests.columns else F.col("content")
    pt = word_count(src)
    ct = word_count(text)
    return _finish(
        requests.select(
            "request_id",
            text.alias("text"),
            F.lit(model).alias("model"),
            pt.alias("prompt_tokens"),
            ct.alias("completion_tokens"),
            (pt + ct).alias("total_tokens"),
            F.lit(None).cast("string").alias("failure"),
            F.lit(None).cast("string").alias("cause"),
        )
    )


def lead_text(content: Column, max_length: Column) -> Column:
    """S10 as an expression: the first ``max_length`` words (all when max_length <= 0)."""
    w = words(content)
    n = F.when(max_length > 0, max_length).otherwise(F.size(w))
    return F.array_join(F.slice(w, 1, n), " ")


def lead_completer(requests: DataFrame) -> DataFrame:
    """The first ``max_length`` words (all words when max_length <= 0)."""
    return _offline(requests, lead_text(F.col("content"), F.col("max_length")), "offline-lead")


def _sentences(content: Column) -> Column:
    """The trimmed sentences of a text, blank ones included."""
    return F.transform(F.regexp_extract_all(content, F.lit(SENTENCE_RE), 0), ws_trim)


def sentence_table(docs: DataFrame) -> DataFrame:
    """Sentences of each text with their position and lower-cased terms."""
    sentences = F.filter(_sentences(F.col("content")), lambda s: s != "")
    # outer, as a plain explode makes the optimizer add a filter that cuts every text twice
    return docs.select("request_id", F.posexplode_outer(sentences).alias("pos", "sentence")).filter(F.col("pos").isNotNull()).withColumn(
        "terms", F.regexp_extract_all(F.lower(F.col("sentence")), F.lit(TERM_RE), 0)
    )


def _occurrences(sentences: DataFrame) -> DataFrame:
    # explode_outer + NULL filter: a plain explode makes the optimizer add a
    # size(terms) > 0 filter that re-runs the term regex for every sentence
    return sentences.select("request_id", F.explode_outer("terms").alias("term")).filter(F.col("term").isNotNull())


def _term_counts(sentences: DataFrame) -> DataFrame:
    """``tf`` per (request, term): one exchange on (request_id, term) after
    map-side partial counts."""
    return _occurrences(sentences).groupBy("request_id", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def _frequencies(docs: DataFrame) -> DataFrame:
    """``df`` of every term of the texts (request_id, content), whose ids are keys: a text's terms
    are made distinct in place, so only partial counts per term are shuffled."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(F.col("content")), F.lit(TERM_RE), 0))
    found = docs.select(F.explode_outer(terms).alias("term")).filter(F.col("term").isNotNull())
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _runs(docs: DataFrame, items: str, term: Callable[[Column], Column]) -> DataFrame:
    """Adds ``starts``: the places in the sorted array ``items`` where another term begins, and one past its end."""
    first = F.transform(items, lambda x, i: F.when((i == 0) | (term(x) != term(F.get(items, i - 1))), i))
    return docs.withColumn("starts", F.concat(F.filter(first, lambda i: i.isNotNull()), F.array(F.size(items))))


def _run_length(start: Column, i: Column) -> Column:
    return F.get("starts", i + 1) - start


def _begun(groups: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.slice("starts", 1, F.size("starts") - 1), groups)


def _once_and_again(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``request_id`` is found once, and those that share one (or NULL) with others.

    A text of its own is counted in place, so its terms are not shuffled by request."""
    again = docs.groupBy("request_id").count().where("count > 1").select(F.col("request_id").alias("_repeated"))
    again = written_table(again, "repeated-requests")
    same = F.col("request_id").eqNullSafe(F.col("_repeated"))
    return docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")


def _request_counts(requests: DataFrame) -> DataFrame:
    """``tf`` per (request, term): in place where the request is one row, else by :func:`_term_counts`."""
    once, again = _once_and_again(requests.select("request_id", "content"))
    terms = F.regexp_extract_all(F.lower(F.col("content")), F.lit(TERM_RE), 0)
    runs = _runs(once.select("request_id", F.sort_array(terms).alias("terms")), "terms", lambda t: t)
    found = _begun(lambda start, i: F.struct(F.get("terms", start).alias("term"), _run_length(start, i).cast("long").alias("tf")))
    counted = runs.select("request_id", F.explode_outer(found).alias("found")).filter(F.col("found").isNotNull()).select("request_id", "found.*")
    return counted.unionByName(_term_counts(again.select("request_id", terms.alias("terms"))))


def _least_frequent(dfreq: DataFrame, most: int) -> int | None:
    """The least ``df`` from which on there are at most ``most`` terms; None if even the most frequent are more."""
    steps = dfreq.groupBy(F.floor(F.log2("df") * 8).alias("step")).agg(F.min("df").alias("df"), F.count(F.lit(1)).alias("n"))
    least, held = None, 0
    for r in sorted(steps.collect(), key=lambda r: -r["step"]):  # a few hundred rows
        held += r["n"]
        if held > most:
            break
        least = r["df"]
    return least


def _weights(tf: DataFrame, dfreq: DataFrame, extra: tuple[str, ...] = (), hot: list[str] | None = None, salts: int = 64, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame | None]:
    """Joins ``df`` to the term counts: (rows weighted in place, rows that were shuffled by term or None).

    The frequencies of the ``frequent`` most frequent terms are copied to all tasks, so most rows
    of natural texts stay where they are; the rows of all other terms are shuffled by term, that of
    ``hot`` terms in ``salts`` parts each, by request. A term that ``dfreq`` does not hold counts as one text's."""
    stored = written_table(dfreq.select("term", F.col("df").cast("long").alias("df")), "term-frequencies")
    on, keyed = ["term"], tf

    def copies(terms: DataFrame) -> DataFrame:
        return terms

    if hot is not None:
        on = ["term", "salt"]
        is_hot = F.col("term").isin(hot) if hot else F.lit(False)
        keyed = tf.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("request_id"), F.lit(salts))).otherwise(0).cast("int"))

        def copies(terms: DataFrame) -> DataFrame:
            salt = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            return terms.select("term", "df", F.explode(salt).alias("salt"))

    def weighted(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("df", F.coalesce("df", F.lit(1).cast("long")))
        return rows.select("request_id", "term", "tf", "df", F.expr(f"(tf * {WEIGHT_SCALE}L) div df").alias("weight"), *extra)

    least = _least_frequent(stored, frequent)
    if least is None:
        none = stored.where(F.lit(False))
        return weighted(keyed.join(F.broadcast(copies(none)), on)), weighted(keyed.join(copies(stored), on, "left"))
    if least <= 1:
        return weighted(keyed.join(F.broadcast(copies(stored)), on, "left")), None
    often, seldom = copies(stored.where(F.col("df") >= least)), copies(stored.where(F.col("df") < least))
    rest = keyed.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom, on, "left")
    return weighted(keyed.join(F.broadcast(often), on)), weighted(rest)


def _both(parts: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    return parts[0] if parts[1] is None else parts[0].unionByName(parts[1])


def hot_terms(requests: DataFrame, share: float = 0.01, most: int = 256, tracked: int = 20000) -> list[str]:
    """Terms that a frequent-items sketch finds in at least ``share`` of all texts, at most ``most``.

    Every task keeps at most ``tracked`` counters, which are merged; a term of more than 1 / ``tracked``
    of all (text, term) pairs is surely among them. The terms only choose the way of their rows.
    """
    terms = requests.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("content")), F.lit(TERM_RE), 0))).alias("term"))
    found = terms.select(F.expr(f"approx_top_k(term, {most}, {tracked})").alias("top")).first()[0]
    least = share * requests.count()
    return [r["item"] for r in found or [] if r["item"] is not None and r["count"] >= least]


def _weight_parts(requests: DataFrame, corpus: DataFrame | None = None, hot: list[str] | None = None, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame | None]:
    tf = _request_counts(requests)
    if corpus is None:
        dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        dfreq = _corpus_frequencies(corpus)
    return _weights(tf, dfreq, hot=hot, frequent=frequent)


def _corpus_frequencies(corpus: DataFrame) -> DataFrame:
    found = corpus.select("request_id", F.explode(F.regexp_extract_all(F.lower(F.col("content")), F.lit(TERM_RE), 0)).alias("term"))
    return found.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_weights(requests: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Per-(request, term) integer weights ``tf * 1e6 div df``.

    Terms are letter/digit runs, which never cross a sentence terminator, and
    every other character belongs to some sentence, so tokenizing whole texts
    gives exactly the terms of the sentences without splitting them first."""
    return _both(_weight_parts(requests, corpus))


def _positions(docs: DataFrame) -> DataFrame:
    """(request_id, term, tf, positions): every different term of a request with one (pos, n_words) of its
    sentence per occurrence. A sentence without terms stands under the empty term."""
    once, again = _once_and_again(docs.select("request_id", "content"))
    lines = F.filter(_sentences(F.col("content")), lambda s: s != "")
    cut = F.transform(lines, lambda s, i: F.struct(i.alias("pos"), word_count(s).alias("n_words"), F.regexp_extract_all(F.lower(s), F.lit(TERM_RE), 0).alias("terms")))
    held = F.transform("cut", lambda s: F.transform(
        F.when(F.size(s["terms"]) > 0, s["terms"]).otherwise(F.array(F.lit(""))), lambda t: F.struct(t.alias("term"), s["pos"].alias("pos"), s["n_words"].alias("n_words"))))
    at = _runs(once.select("request_id", cut.alias("cut")).select("request_id", F.sort_array(F.flatten(held)).alias("items")), "items", lambda x: x["term"])
    found = _begun(lambda start, i: F.struct(
        F.get("items", start)["term"].alias("term"), _run_length(start, i).cast("long").alias("tf"),
        F.transform(F.slice("items", start + 1, _run_length(start, i)), lambda x: F.struct(x["pos"].alias("pos"), x["n_words"].alias("n_words"))).alias("positions")))
    single = at.select("request_id", F.explode_outer(found).alias("found")).filter(F.col("found").isNotNull()).select("request_id", "found.*")
    sentences = sentence_table(again).select("request_id", F.struct("pos", word_count(F.col("sentence")).alias("n_words")).alias("at"), "terms")
    shared = sentences.select("request_id", "at", F.explode_outer("terms").alias("term")).groupBy("request_id", F.coalesce("term", F.lit("")).alias("term"))
    shared = shared.agg(F.count(F.lit(1)).alias("tf"), F.collect_list("at").alias("positions"))
    return single.unionByName(shared)


def extractive_summaries(requests: DataFrame, corpus: DataFrame | None = None, frequent: int = FREQUENT) -> DataFrame:
    """S11 text per request: best sentences by summed term weight (ties: earlier
    first) taken while the words before them are under ``max_length``, output
    in document order; ``bullet_points`` gives one ``- `` line per sentence.

    Scoring and ranking see no text: a text's terms are grouped in place (:func:`_positions`), and
    most get their weights there (:func:`_weights`). Only sums per sentence are shuffled by request,
    and the rows of seldom terms by term. The chosen positions are joined back
    to the texts, which are cut into sentences again; that is cheaper than
    carrying or writing them. Every group (a request's sentences, a
    request-term's positions) is bounded by one text.
    """
    docs = requests.select("request_id", "content", "max_length", "style")
    # counting df from the texts costs a second pass over them, less than lists of positions twice
    dfreq = _frequencies(docs) if corpus is None else _corpus_frequencies(corpus)
    # the empty term, of which many sentences may be, counts as so frequent that it weighs 0
    dfreq = dfreq.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(1 << 62).alias("df")))
    weights = _both(_weights(_positions(docs), dfreq, ("positions",), frequent=frequent))
    weights = weights.select("request_id", "weight", F.explode("positions").alias("at")).select("request_id", "weight", "at.*")
    scores = weights.groupBy("request_id", "pos", "n_words").agg(F.sum("weight").alias("score"))
    ranked = scores.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "pos", "n_words"))).alias("_r"))
    # the chosen sentences are the first ones of the ranking: one pass counts them
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("n"))
    taken = F.aggregate(
        "_r", start,
        lambda a, r: F.struct((a["words"] + r["n_words"]).alias("words"), (a["n"] + F.when(a["words"] < F.col("max_length"), 1).otherwise(0)).alias("n")),
        lambda a: a["n"])
    positions = F.transform(F.slice("_r", 1, taken), lambda r: r["pos"])
    picked = docs.join(ranked, "request_id").withColumn("_p", F.when(F.col("max_length") > 0, positions))
    # a choice is at most max_length positions long, so looking up each sentence in it stays cheap
    lines = F.filter(_sentences(F.col("content")), lambda s: s != "")
    lines = F.filter(lines, lambda s, i: F.col("_p").isNull() | F.array_contains("_p", i))
    text = F.when(
        F.col("style") == "bullet_points", F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    ).otherwise(F.array_join(lines, " "))
    return picked.select("request_id", text.alias("summary_text"))


def extractive_completer(corpus: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    def run(requests: DataFrame) -> DataFrame:
        texts = extractive_summaries(requests, corpus)
        j = requests.join(texts, "request_id", "left")
        return _offline(j, F.coalesce(F.col("summary_text"), F.lit("")), "offline-extractive")

    return run


def _leading(rows: DataFrame, k: int) -> DataFrame:
    """Of every batch of rows the first ``k`` per request by weight desc, then term: all that can rank.

    Rows weighted in place come text by text, so this keeps little more than ``k`` rows of a text
    and the sort for the window no longer holds (and spills) every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            request = b.column("request_id").dictionary_encode("encode").indices
            keys = pa.table({"request": request, "weight": b.column("weight"), "term": b.column("term")})
            order = pc.sort_indices(keys, sort_keys=[("request", "ascending"), ("weight", "descending"), ("term", "ascending")]).to_numpy()
            request, place = request.to_numpy()[order], np.arange(len(order))
            new = np.concatenate([[True], request[1:] != request[:-1]])
            yield b.take(pa.array(order[place - np.maximum.accumulate(np.where(new, place, 0)) < k]))

    return rows.mapInArrow(run, rows.schema)


def top_keywords(requests: DataFrame, corpus: DataFrame | None = None, k: int = TOP_KEYWORDS, hot: list[str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Up to ``k`` terms per request ranked by weight desc, then term.
    With ``hot`` (:func:`hot_terms`) the weight join splits these terms by salt.

    ``row_number() <= k`` over a window lets Spark apply the per-group limit
    before the shuffle (window group limit), so each request ships at most k
    rows per partition."""
    here, shuffled = _weight_parts(requests, corpus if hot is None else None, hot, frequent)
    weights = _both((_leading(here, k), shuffled))
    w = Window.partitionBy("request_id").orderBy(F.col("weight").desc(), F.col("term"))
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword_completer(corpus: DataFrame | None = None, k: int = TOP_KEYWORDS) -> Callable[[DataFrame], DataFrame]:
    def run(requests: DataFrame) -> DataFrame:
        top = top_keywords(requests, corpus, k)
        agg = top.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
        text = F.array_join(F.transform("_t", lambda t: t["term"]), ", ")
        j = requests.join(agg.select("request_id", text.alias("_kw")), "request_id", "left")
        return _offline(j, F.coalesce(F.col("_kw"), F.lit("")), "offline-keywords")

    return run


def complete(requests: DataFrame, completer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One completion row per request; failures are rows."""
    return completer(requests)
