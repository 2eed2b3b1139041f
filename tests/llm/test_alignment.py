"""Cross-tokenizer alignment against a plain version with byte sets."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import documents, frame
from tokenizers import Tokenizer

from webtext.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [None, "", " ", "\n", "▁ a", "a▁b", "<s> </s><|endoftext|><0x41><unk>", "é𝕏 ü" * 30, "  two  spaces ", "the " * 5000, "x" * 4000, "日本語テキスト" * 50, "a\x00b"]


def plain(rows):
    """doc -> result, by the definition: byte by byte, pair by pair."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    signs = {c: i for i, c in _byte_signs().items()}
    out, links_of = [], []
    for doc_id, text in rows:
        parts_a, parts_b, ids = [], [], ([], [])
        if text:
            got = a.encode(" " + text, add_special_tokens=False)
            ids = (got.ids, b.encode(text))
            parts_a = [bytes(signs[c] for c in t) for t in got.tokens]
            parts_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids[1])]
            if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
                parts_a, parts_b, ids = [], [], ([], [])
        spans = [[(s, s + len(p)) for s, p in zip(np.cumsum([0, *map(len, ps)]).tolist(), ps, strict=False)] for ps in (parts_a, parts_b)]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(own, span, strict=True) if s >= begin and e <= cut) for own, span in zip(ids, spans, strict=True)))
            begin = cut
        links, low = [], 0
        for i, (s, e) in zip(ids[0], spans[0], strict=True):
            while low < len(spans[1]) and spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, ids[1][k]))
                k += 1
        links_of.append(links)
        out.append([doc_id, len(ids[0]), len(ids[1]), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""])
    count = Counter(x for links in links_of for x in links)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return sorted([(*o[:5], sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), o[5]) for o, links in zip(out, links_of, strict=True)], key=str)


def _byte_signs():
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain_bytes]
    return {**{b: chr(b) for b in plain_bytes}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def test_alignment_against_plain_version(spark):
    rows = documents(seed=4, n=40)
    rows += [(2**53 + i, t, None, None, None, None, None) for i, t in enumerate(AWKWARD)] + [(None, "the end", None, None, None, None, None)]
    docs = frame(spark, rows).repartition(5)
    want = plain([r[:2] for r in rows])
    for block_bytes in (3000, 1 << 23):  # many blocks, and one a partition
        got = alignment.align(docs.withColumnRenamed("row", "block"), A_PATH, B_PATH, block_bytes=block_bytes)
        assert sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()], key=str) == want
    assert alignment.align(docs.limit(0), A_PATH, B_PATH).count() == 0
    assert alignment.align(docs.where("text is null"), A_PATH, B_PATH).agg({"n_links": "sum"}).first()[0] == 0


def test_query(spark, tmp_path):
    rows = documents(seed=9, n=12)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = alignment.op12_cross_tokenizer_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain([r[:2] for r in rows])


def test_gallop_finds_every_rank():
    rng = np.random.default_rng(3)
    for n in (1, 2, 10, 1000):
        into = np.unique(rng.integers(0, 3 * n, n))
        ends = np.sort(rng.integers(-2, 3 * n + 2, 50))
        for start in (np.zeros(50, np.int64), np.full(50, len(into)), rng.integers(0, len(into) + 1, 50)):
            assert (alignment.gallop(ends, into, start) == np.searchsorted(into, ends)).all()
