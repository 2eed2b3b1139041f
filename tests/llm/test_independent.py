"""Language ID, chunk dedup and nearest neighbours against versions written apart from them, through their queries."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from helpers import documents, frame, sentence
from test_others import labelled

from webtext.llm import chunk_dedup, language_id, nearest


def plain_features(text):
    """Trigram shares by hash, character by character."""
    kept, out = " ", Counter()
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or kept[-1] != " ":
            kept += c
    if kept[-1] != " ":
        kept += " "
    for a, b, c in zip(kept, kept[1:], kept[2:], strict=False):
        h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) & 0xFFFFFFFF
        out[((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20] += 1
    total = max(1, sum(out.values()))
    return {k: math.sqrt(v / total) for k, v in out.items()}


def plain_vote(level, x):
    if len(level.labels) == 1:
        return level.labels[0], 1.0
    votes = [0.0] * len(level.labels)
    for (i, j), w in zip(level.pairs, level.weights, strict=True):
        sure = 1 / (1 + math.exp(-language_id.SLOPE * (sum(w[k] * v for k, v in x.items()) + w[-1])))
        votes[i] += sure
        votes[j] += 1 - sure
    best = max(range(len(votes)), key=lambda i: (votes[i], -i))
    return level.labels[best], votes[best] / (len(votes) - 1)


def test_language_query_against_plain_votes(spark, tmp_path):
    rng = random.Random(17)
    rows = labelled(160) + [(500 + i, sentence(rng, "de", 4), None, "s", 1, "r", 5) for i in range(5)] + [(600, None, "en", "s", 1, "r", 5), (601, "1 2", "fr", "s", 1, "r", 5), (None, "the wing", None, "s", 1, "r", 5)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = language_id.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.learn(docs.where(~language_id.held_out(docs.doc_id)))
    assert len(model.families.labels) == 2 and all(len(v.labels) == 2 for v in model.languages.values())  # both levels vote
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        t = text[r.doc_id]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = plain_features(t)
        family, one = plain_vote(model.families, x)
        label, two = plain_vote(model.languages[family], x)
        assert r.lang_pred == label and abs(r.score - one * two) < 1e-4
    out = [r for r in got if r.held_out and r.doc_id < 160]
    assert len(out) > 30 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in out]) > 0.95


def plain_cuts(data):
    """Ends of the chunks, byte by byte."""
    h, candidates = 0, [0]
    for i, b in enumerate(data):
        h = (2 * h + int(chunk_dedup._GEAR[b])) & 0xFFFF
        if h < 65536 // chunk_dedup.SPREAD:
            candidates.append(i + 1)
    cuts = [c for before, c in zip(candidates, candidates[1:], strict=False) if c - before >= chunk_dedup.SMALLEST and c < len(data)]
    out, last = [], 0
    for end in [*cuts, len(data)]:
        while end - last > chunk_dedup.LARGEST:
            last += chunk_dedup.LARGEST
            out.append(last)
        out.append(end)
        last = end
    return out if data else []


def test_chunk_query_against_plain_chunks(spark, tmp_path):
    rows = documents(seed=12) + [(2**53 + 1, documents(seed=12)[5][1], None, None, None, None, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = chunk_dedup.op5_substring_dedup(spark, str(tmp_path)).collect()
    seen, want = set(), {}

    def order(d):
        import xxhash

        h = xxhash.xxh64_intdigest(d[1].encode(), 42)
        return (d[0] is not None, d[0] or 0, h - (1 << 64) if h >> 63 else h)

    for d in sorted({(r[0], r[1] or "") for r in rows}, key=order):
        data, start, mark, runs = d[1].encode(), 0, [], []
        for end in plain_cuts(data):
            again = data[start:end] in seen
            seen.add(data[start:end])
            mark.append((start, end, again))
            start = end
        for s, e, again in mark:
            if again and runs and runs[-1][1] == s:
                runs[-1][1] = e
            elif again:
                runs.append([s, e])
        runs = [r for r in runs if r[1] - r[0] >= chunk_dedup.LEAST]
        kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in runs]], [*[s for s, _ in runs], len(data)], strict=True))
        want[d] = (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == sorted((str(r[0]), *want[(r[0], r[1] or "")]) for r in rows)
    assert any(g.n_removed for g in got)


def test_collisions_prune_and_reach_the_recall(spark, tmp_path):
    """A block well above the floor: candidates are chosen by collisions, not all vectors."""
    n, rng = 4000, np.random.default_rng(21)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, n)] + 0.7 * rng.standard_normal((n, 32))).astype(np.float32)
    block = nearest.ProjectionBlock(x.astype(np.float64))
    own = np.arange(0, n, 400)
    found = block.search(x[own].astype(np.float64), 21, np.arange(n), own)
    assert max(len(f) for f in found) < n / 2 and min(len(f) for f in found) >= nearest.FLOOR * 21
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in nearest.op8_approximate_nearest_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, n, 20))
    score = x[::20].astype(np.float64) @ x.astype(np.float64).T
    score[np.arange(n // 20), np.arange(0, n, 20)] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :20]
    assert np.mean([len(got[20 * q] & set(b.tolist())) / 20 for q, b in enumerate(best)]) >= 0.9
