"""URL filter, chat formatting, language ID, pieces, nearest neighbours and packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SYLLABLES, documents, frame, sentence

from webtext.llm import chat_format, language_id, nbest_pieces, nearest, packing, url_filter


def test_url_filter_against_brute_force(spark):
    rng = random.Random(5)
    labels, paths = ["net", "com", "a", "b", "example", ""], ["", "/", "/en/", "/en/x", "/de", "/e"]
    rules = [(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(40)]
    urls = ["https://" + ".".join(rng.choices(labels + ["A"], k=rng.randint(1, 4))) + rng.choice(paths) + rng.choice(["", "?q=/", "#x"]) for _ in range(150)]
    urls += [None, "", "no-scheme/x", "http://", "http:///en/", "x://Net?a://b", urls[0], urls[0], "http://" + "a." * 100 + "net/en/" + "y" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[1])], "page_id long, url string").selectExpr("*", "1 as host", "2 as key", "3 as `open`")
    got = url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules), ranges=5).collect()
    assert len(got) == len(urls) + 1

    def judge(url):
        _, found, rest = (url or "").partition("://")
        if not found:
            rest = ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host):].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), len(h), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, "allow", None))
        return host, path, best[3], best[2]

    for g in got:
        assert (g.host, g.path, g.rule, g.verdict) == judge(urls[g.page_id] if g.page_id is not None else urls[1])
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "\\l|", "\\b", "<", "|", "\n", "text", "é𝕏", "<\\|", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "<|x", None]), "".join(rng.choices(bits, k=5)), 1) for c in range(25) for t in rng.sample(range(300), rng.randint(1, 12))]
    rows += [(99, t, "assistant", "x" * t, 1) for t in range(200)] + [(None, None, None, None, 1), (50, 1, "user", "b", 1), (50, 1, "user", "a", 1), (50, 1, "user", "a", 1), (50, None, "user", "z", 1)]
    frame_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    made = chat_format.format_conversations(frame_)
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    text = {r.conv_id: r for r in made.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")
        assert r.formatted_chars == len(text[conv].formatted)
        merged = sum(i == 0 or want[i][0] != want[i - 1][0] for i in range(len(want)))
        assert text[conv].formatted.count(chat_format.START) == merged == text[conv].formatted.count(chat_format.END)
    assert chat_format.format_conversations(frame_.limit(0)).count() == 0


def labelled(n=240):
    rng = random.Random(7)
    return [(i, sentence(rng, lang, rng.randint(8, 40)), lang, "s", 1, "r", 5) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=n))]


def test_language_held_out_accuracy(spark):
    rows = labelled() + [(900, None, "en", None, None, None, None), (901, "12 ...", "en", None, None, None, None), (902, "", None, None, None, None, None), (903, "the and " * 300000, None, None, None, None, None)]
    docs = frame(spark, rows)
    model = language_id.learn(docs.where(~language_id.held_out(docs.doc_id)), per_language=40)
    assert sorted(model.families.labels) == ["germanic", "romance"]
    got = {r.doc_id: r for r in language_id.predict_language(docs, model).collect()}
    out = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in out]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902)) and got[903].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_known(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == 241


def test_language_stage_drops_only_texts_without_a_letter(spark):
    noise = random.Random(14)
    rows = labelled(120) + [(900 + i, "".join(noise.choices("qxzjкщ日あ", k=30)), None, None, None, None, None) for i in range(20)]
    docs = frame(spark, rows + [(990, "12 ...", None, None, None, None, None), (991, None, None, None, None, None, None)])
    model = language_id.learn(docs, per_language=40)
    scores = [r.score for r in language_id.predict_language(docs, model).collect() if r.lang_pred != "und"]
    assert len(scores) == len(rows) and min(scores) >= 0.25
    assert {r.doc_id for r in language_id.keep_known(docs, model).collect()} == {r[0] for r in rows}


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "text", None, None, None, None, None)])
    assert language_id.learn(docs) is None
    assert [r.lang_pred for r in language_id.predict_language(docs, None).collect()] == ["und"]
    one = language_id.learn(frame(spark, labelled(1)))
    assert len({r.lang_pred for r in language_id.predict_language(docs, one).collect()}) == 1
    assert language_id.predict_language(docs.limit(0), one).count() == 0


def test_trigrams_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(8)
    text = sentence(rng, "de", 50) + "  12 !! " + sentence(rng, "fr", 50)
    whole = language_id.trigram_counts(text)
    monkeypatch.setattr(language_id, "PART", 7)
    assert (language_id.trigram_counts(text) == whole).all()


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_scores(m, prepared):
    memo = {len(prepared): [0.0]}
    for i in range(len(prepared) - 1, -1, -1):
        out = [m.scores[prepared[i:j]] + s for j in range(i + 1, min(len(prepared), i + 16) + 1) if prepared[i:j] in m.ids for s in memo[j]]
        if prepared[i] not in m.ids:
            out += [m.byte_score * len(prepared[i].replace(nbest_pieces.LITERAL, nbest_pieces.MARK).encode()) + s for s in memo[i + 1]]
        memo[i] = out
    return sorted(memo[0], reverse=True)


def test_pieces_n_best_and_round_trip():
    m, rng = nbest_pieces.load_model(MODEL), random.Random(9)
    for text in ["Hello world", "  a  b", "ß日x", "▁a ▁", "\n\n a", "x" * 12, "1,2. end²."] + ["".join(rng.choices("the na▁ß𝕏 ,.", k=rng.randint(1, 9))) for _ in range(60)]:
        got = m.encode(text, 5)
        want = all_scores(m, nbest_pieces.MARK + text.replace(nbest_pieces.MARK, nbest_pieces.LITERAL).replace(" ", nbest_pieces.MARK))[:5]
        assert [s for s, _ in got] == pytest.approx(want)
        assert len({tuple(i) for _, i in got}) == len(got)
        assert all(m.decode(i) == text for _, i in got)


def test_pieces_of_documents(spark):
    rows = documents()
    docs = frame(spark, rows)
    encoded = nbest_pieces.encode_documents(docs, MODEL, 2)
    back = nbest_pieces.decode_documents(encoded, MODEL).collect()
    texts = sorted((str(r[0]), r[1] or "") for r in rows)
    assert sorted((str(r.doc_id), r.text) for r in back if r["rank"] == 1) == texts
    assert {(str(r.doc_id), r.text) for r in back} == set(texts)
    found = nbest_pieces.summaries(docs, MODEL, 2, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), r["rank"], r.ids_crc32, r.n_pieces) for r in found) == sorted((str(r.doc_id), r["rank"], zlib.crc32(np.array(r.ids, "<u4").tobytes()), len(r.ids)) for r in back)
    assert nbest_pieces.encode_documents(docs.limit(0), MODEL).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[5] = x[40] = x[41] = x[0]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)] + [(700, None, 1, 2), (701, [0.0] * 16, 1, 2), (720, [float("nan")] * 16, 1, 2), (740, [None] * 16, 1, 2), (None, x[1].tolist(), 1, 2), (760, [1.0, 2.0], 1, 2), (780, [float("inf")] * 16, 1, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, `rank` int")
    got = {}
    for r in nearest.nearest(vectors, lambda i: i % 20 == 0, 20, block_rows=200, query_rows=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    hits = total = 0
    for q, found in got.items():
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == pytest.approx(score[f[1]], rel=1e-12) for f in found)
        hits, total = hits + len({f[1] for f in found} & set(want)), total + 20
        copies = [i for i in want if i in (0, 5, 40, 41)]  # ties: smaller ids first
        assert [f[1] for f in found if f[1] in copies] in (copies, [])
    assert hits / total >= 0.9
    assert nearest.nearest(vectors.limit(0), lambda i: i % 20 == 0).count() == 0


def test_nearest_repeated_rows(spark):
    v, rng = [1.0, 2.0, 2.0], np.random.default_rng(13)
    far = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((30, 3)) / 100, 100)]
    rows = [(20, v)] * 25 + [(21, v)] + [(5, v)] * 3 + far
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(nearest.nearest(vectors, lambda i: i == 20, 20).collect(), key=lambda r: r["rank"])
    own = {i: np.array(x, np.float32).astype(float) for i, x in rows if i != 20}
    want = sorted((-float(x @ own[21]), i) for i, x in own.items())[:20]
    assert [(r["rank"], r.vec_id) for r in got] == [(k, i) for k, (_, i) in enumerate(want, 1)]
    assert [r.score for r in got] == pytest.approx([-s for s, _ in want])


def vectors_of_one_id(spark, n):
    """Id 20 with the vectors (1, -1) to (n, -1), and 30, 31, 32 with (1, 0), (1, 1), (1, 2)."""
    many = spark.range(n).selectExpr("20L as vec_id", "array(cast(1 + id as float), cast(-1 as float)) as embedding")
    return many.union(spark.range(3).selectExpr("30 + id as vec_id", "array(cast(1 as float), cast(id as float)) as embedding"))


def test_nearest_id_of_more_vectors_than_a_block(spark):
    got = nearest.nearest(vectors_of_one_id(spark, 70000), lambda i: i == 31, 5).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(k, 20, 70000.0 - k) for k in range(1, 6)]


def test_nearest_own_rows_are_no_candidates(spark):
    got = nearest.nearest(vectors_of_one_id(spark, 1000), lambda i: i == 20, 3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 30, 1000.0), (2, 30, 999.0), (3, 31, 999.0)]


def test_differencing_and_windows():
    rng = np.random.default_rng(11)
    sizes = rng.integers(1, 2048, 400)
    for found in (packing.difference(sizes, 90), packing.windows_of(sizes, 2048)):
        assert sorted(i for w in found for i in w) == list(range(400))
    found = packing.windows_of(sizes, 2048)
    assert max(sizes[w].sum() for w in found) <= 2048
    assert sizes.sum() / (2048 * len(found)) > 0.9
    assert packing.windows_of(np.empty(0, np.int64), 2048) == []
    assert len(packing.windows_of(np.full(7, 2000), 2048)) == 7


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = documents()
    pieces = packing.pack(frame(spark, rows), path, group_windows=4).collect()
    sequences, docs = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) <= 2048
    want = sorted((str(r[0]), zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()), s, n, len(ids)) for r in rows for ids in [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]] for s, n in packing.cuts(len(ids), 2048, 2048))
    assert sorted((str(p.doc_id), p.ids_crc32, p.start, p.length, p.doc_tokens) for p in pieces) == want
    assert packing.pack(frame(spark, []), path).count() == 0


def test_packing_long_white_space(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    spaces = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    texts = [" " * 1_000_001 + "x", "\n" * 1_200_000, "a" + spaces * 50_000 + " b", *[f"a{' ' * n}b" for n in (32767, 32768, 32769)], "a b " * 20_000]
    want = sorted((i, len(ids), zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for i, t in enumerate(texts) for ids in [tokenizer.encode(t, add_special_tokens=False).ids + [1]] for s, n in packing.cuts(len(ids), 2048, 2048))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((p.doc_id, p.doc_tokens, p.ids_crc32) for p in packing.pack(docs, path).collect()) == want


def test_quick_encoder_splits_like_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.load_encoder(path)
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for s in range(0, len(chars), 256):
        text = "".join(f"the{c}the 1{c}1 !{c}! {c}\n" for c in chars[s:s + 256])
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_sequence_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, sentence(random.Random(i), "en", 200 * i), None, None, None, None, None) for i in range(1, 9)]
    docs = frame(spark, rows)
    pieces = packing.pack(docs, path)
    whole = {r.sequence_id: r.ids for r in packing.sequence_ids(pieces, docs, path).collect()}
    for p in pieces.collect():
        ids = whole[p.sequence_id]
        assert len(ids) == 2048 or len(ids).bit_count() == 1
        assert zlib.crc32(np.array(ids[p.offset:p.offset + p.length], "<u4").tobytes()) == p.ids_crc32


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = labelled(60) + [(100, labelled(60)[0][1], "en", "s", 1, "r", 5), (101, "123 456", "en", "s", 1, "r", 5)]
    rows += [(102, labelled(60)[1][1] + " " + sentence(rng, "en", 40), "en", "s", 1, "r", 5)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.collect()}
    assert 101 not in kept["language_id"] and len(kept["language_id"]) == 62
    assert kept["exact_dedup"] == kept["language_id"] - {0}
    assert len(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()) == len(kept["suffix_array_dedup"])
    assert hashlib.sha256(b"").hexdigest()


def without_repeats(docs, length):
    """(id, text) in order of id -> text without the strings of ``length`` bytes that start earlier, whole characters only."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        b = text.encode()
        mark = [False] * len(b)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                mark[s:s + length] = [True] * length
            seen.add(b[s:s + length])
        kept, s = bytearray(), 0
        while s < len(b):
            e = next((k for k in range(s, len(b)) if mark[k] != mark[s]), len(b))
            if mark[s]:  # a range is narrowed to whole characters
                first = next((k for k in range(s, e) if b[k] & 0xC0 != 0x80), e)
                last = next((k for k in range(e, first, -1) if k == len(b) or b[k] & 0xC0 != 0x80), first)
                kept += b[s:first] + b[last:e]
            else:
                kept += b[s:e]
            s = e
        out[i] = kept.decode()
    return out


def test_pipeline_rows_equal_plain_python(spark, tmp_path):
    import unicodedata

    from test_dedup import brute_components, brute_fingerprint
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(15)
    rows = documents()
    base = sentence(rng, "en", 150)
    rows += [(200, base, "en", "s", 1, "r", 5), (201, base + ".", "en", "s", 1, "r", 5), (202, base.replace(" ", "  "), "de", "s", 1, "r", 5)]
    rows += [(203, sentence(rng, "fr", 30) + " é" * 90 + base[:400] + "ü" * 200, "fr", "s", 1, "r", 5), (204, sentence(rng, "de", 3000), "de", "s", 1, "r", 5)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))

    known = [r for r in rows if any(unicodedata.category(c)[0] == "L" for c in r[1] or "")]
    largest = {}
    for r in known:
        largest[r[1]] = max(largest.get(r[1], -1), -1 if r[0] is None else r[0])
    texts = sorted((i, t) for t, i in largest.items())
    assert len({i for i, _ in texts}) == len(texts) and texts[0][0] >= 0
    component = brute_components([brute_fingerprint(t, 4) for _, t in texts], 4)
    least = {}
    for (i, t), c in zip(texts, component, strict=True):
        least.setdefault(c, (i, t))
    near = dict(least.values())
    cut = without_repeats(near, 100)
    assert len(rows) > len(known) > len(texts) > len(near) and any(cut[i] != t for i, t in near.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in cut.items()}
    want = sorted((i, s, n, zlib.crc32(np.array(x[s:s + n], "<u4").tobytes()), len(x)) for i, x in ids.items() for s, n in packing.cuts(len(x), 2048, 2048))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got) == want
    sequences = {}
    for p in sorted(got, key=lambda p: p.offset):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values()) <= 2048


def test_queries_without_reference_sql(spark, tmp_path):
    from test_dedup import brute_components, brute_fingerprint, brute_removed
    from tokenizers import Tokenizer

    from webtext.llm.queries import QUERIES

    rows, rng = [r for r in documents() if len(r[1] or "") < 4000], np.random.default_rng(16)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    x = rng.standard_normal((60, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    docs = sorted((str(r[0]), r[1] or "") for r in rows)

    def answer(name, columns):
        out = QUERIES[name](spark, str(tmp_path))
        assert out.columns == columns.split()
        return out.collect()

    got = answer("op3_language_id", "doc_id held_out lang_pred score")
    assert sorted((str(g.doc_id), g.held_out, g.lang_pred) for g in got) == sorted(
        (str(r[0]), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1, "en" if any(c.isalpha() for c in r[1] or "") else "und") for r in rows)

    spans = "doc_id n_bytes n_removed n_spans kept_sha256"
    got = answer("op5_substring_dedup", spans)
    assert sorted((str(g.doc_id), g.n_bytes) for g in got) == sorted((d, len(t.encode())) for d, t in docs) and any(g.n_removed for g in got)
    assert all(0 <= g.n_removed <= g.n_bytes and (g.n_spans > 0) == (g.n_removed > 0) and len(g.kept_sha256) == 64 for g in got)
    removed = brute_removed(rows, 100)
    got = answer("op9_suffix_array_dedup", spans)
    assert sorted(map(str, [(str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got])) == sorted(
        map(str, [(str(r[0]), *w[:3], hashlib.sha256(w[3]).hexdigest()) for r in rows for w in [removed[(r[0], r[1] or "")]]]))

    m = nbest_pieces.load_model(MODEL)
    got = answer("op6_sentencepiece", "doc_id rank score n_pieces ids_crc32 text_sha256")
    best = sorted((str(r[0]), k, zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows for k, (_, i) in enumerate(m.encode(r[1] or "", 3), 1))
    assert sorted((str(g.doc_id), g["rank"], g.ids_crc32) for g in got) == best

    fps = [brute_fingerprint(r[1], 4) for r in rows]
    least = {}
    component = brute_components(fps, 4)
    for r, c in zip(rows, component, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    got = answer("op7_simhash_near_dedup", "doc_id fingerprint component_id")
    assert sorted((str(g.doc_id), g.fingerprint, g.component_id) for g in got) == sorted((str(r[0]), f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, component, strict=True))

    score = x.astype(float) @ x.astype(float).T
    got = answer("op8_approximate_nearest_neighbours", "query_id rank vec_id score")
    want = [(q, k, i) for q in (0, 20, 40) for k, i in enumerate([i for i in np.argsort(-score[q], kind="stable") if i != q][:20], 1)]
    assert sorted((g.query_id, g["rank"], g.vec_id) for g in got) == want

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = answer("op10_packing", "doc_id start length ids_crc32 doc_tokens sequence_id offset")
    assert sorted((str(g.doc_id), g.start, g.length, g.ids_crc32) for g in got) == sorted(
        (d, s, n, zlib.crc32(np.array(i[s:s + n], "<u4").tobytes())) for d, t in docs for i in [tokenizer.encode(t, add_special_tokens=False).ids + [1]] for s, n in packing.cuts(len(i), 2048, 2048))


def test_a_long_conversation_of_one_turn_number(spark):
    """Rows without an id and a turn are one block; their texts are merged in one pass."""
    import time

    def made(n):
        rows = spark.range(n).selectExpr("cast(null as long) conv_id", "cast(null as long) turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('t', id) text")
        start = time.perf_counter()
        got = chat_format.read_back(chat_format.format_conversations(rows)).first()
        return got, time.perf_counter() - start

    made(100)
    got, small = made(4000)
    assert len(got.turns) == 4000 and got.loss_text.count("t") == 2666
    _, large = made(32000)
    assert large < 24 * max(small, 0.5)


def test_many_rules_of_one_host(spark):
    """5,000 path rules of one host, nested and apart: no row holds them all, and the longest one wins."""
    rng = random.Random(11)
    paths = sorted({"/" + "/".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(5000)})
    rules = spark.createDataFrame([("big.net", p, "block" if i % 2 else "allow") for i, p in enumerate(paths)] + [("net", "/a", "block")], "host string, path string, action string")
    urls = ["http://x.big.net/" + "/".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(400)] + ["http://big.net/zzz"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, ranges=9).collect()}
    action = {p: "block" if i % 2 else "allow" for i, p in enumerate(paths)}
    for i, url in enumerate(urls):
        path = url.split(".net", 1)[1]
        best = max((path[:n] for n in range(1, len(path) + 1) if path[:n] in action), key=len, default=None)
        want = ("big.net" + best, action[best]) if best else ("net/a", "block") if path.startswith("/a") else (None, "allow")
        assert got[i] == want
    keys = rules.selectExpr("concat('net.big.', chr(0), path) key").where("path is not null")
    from pyspark.sql import functions as F
    longest = url_filter.chains(keys, F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substr("key", F.lit(1), n))).agg(F.max(F.size("chain"))).first()[0]
    assert longest <= 7
