"""Exact, chunk, SimHash and suffix-array dedup against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from helpers import documents, frame, sentence
from pyspark.sql import functions as F

from webtext.llm import chunk_dedup, exact_dedup, occurrences, simhash, suffix_dedup
from webtext.llm.components import connected_components
from webtext.llm.ranges import document_rows, merged_ranges, without_ranges


def ident(row):
    """Order of documents: id (null first), then the text."""
    return (row[0] is not None, row[0] or 0)


def test_exact_dedup_groups(spark):
    rows = documents()
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(hashlib.sha256((r[1] or "").encode()).hexdigest(), []).append(r[0])
    for g in got:
        ids = groups[g.text_sha256]
        assert g.group_size == len(ids)
        assert g.keep_id == max((i for i in ids if i is not None), default=None)
    kept = [(g.text_sha256, g.doc_id) for g in got if g.kept]
    assert len(kept) == len(groups) == len({k[0] for k in kept})
    assert all(d == max((i for i in groups[s] if i is not None), default=None) for s, d in kept)


def test_exact_dedup_keep_one_keeps_columns(spark):
    rows = documents()
    got = exact_dedup.keep_one(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "digest"]
    assert len(got.collect()) == len({r[1] or "" for r in rows})
    assert exact_dedup.keep_one(frame(spark, [])).count() == 0


def test_cuckoo_index_insert_delete_resize():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (3000, 4), dtype=np.uint64)
    index = exact_dedup.CuckooIndex()
    at = index.insert(np.concatenate([keys, keys[:50]]))
    assert (at[:50] == at[3000:]).all() and len(index.keys) == 3000
    assert index.fingerprints.size >= 3000  # it grew from 64 slots
    clash = keys[:1].copy()
    clash[0, 3] ^= np.uint64(1)  # same fingerprint and buckets, other content
    assert index.lookup(clash)[0] == -1
    live = index.delete(keys[:1000])
    assert live.sum() == 2000
    assert (index.lookup(keys[:1000]) < 0).all() and (index.lookup(keys[1000:]) >= 0).all()
    index.insert(keys[:10])
    assert (index.lookup(keys[:10]) >= 0).all()


def test_index_updates(spark):
    rows = documents()
    digests = exact_dedup.digests_of(frame(spark, rows))
    index = exact_dedup.build_index(digests, keys_per_shard=16)
    half = exact_dedup.update_index(index, deleted=digests.where("id < 30"))
    left = {bytes(r.digest) for r in exact_dedup.live_digests(half).collect()}
    gone = {bytes(r.digest) for r in digests.where("id < 30").collect()}
    all_ = {bytes(r.digest) for r in digests.collect()}
    assert left == all_ - gone
    again = exact_dedup.update_index(half, inserted=digests.where("id < 30"))
    assert {bytes(r.digest) for r in exact_dedup.live_digests(again).collect()} == all_


def brute_fingerprint(text, shingle):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_simhash_links_equal_brute_force(spark, bucket_rows):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, 1, (1 << 64) - 1}
    for b in base:  # chains and clouds about the allowed distance
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.links_of(nodes, 4, bucket_rows)
    roots = {r.node: r.component for r in connected_components(links).collect()}
    got = {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        got.setdefault(roots.get(s, s), set()).add(f)
    want = {}
    for f, c in zip(fps, brute_components(fps, 4)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_documents(spark):
    rows = documents()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = [brute_fingerprint(r[1], 4) for r in rows]
    component = brute_components(want, 4)
    least = {}
    for r, c in zip(rows, component):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    expect = sorted((str(r[0]), f, least.get(c)) for r, f, c in zip(rows, want, component))
    assert sorted((str(g.doc_id), g.fp % (1 << 64), g.component_id) for g in got) == expect
    assert simhash.keep_one(frame(spark, rows)).count() == len(set(component))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def brute_removed(rows, length):
    """(id, text) -> (n_removed, spans, kept) with every string of ``length`` bytes that starts earlier removed."""
    seen, out = set(), {}
    docs = {(r[0], r[1] or "") for r in rows}

    def order(d):
        h = xxhash.xxh64_intdigest(d[1].encode(), 42)
        return (d[0] is not None, d[0] or 0, h - (1 << 64) if h >> 63 else h)

    for d in sorted(docs, key=order):
        b = d[1].encode()
        mark = [False] * len(b)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                mark[s:s + length] = [True] * length
            seen.add(w)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[d] = (len(b), sum(mark), spans, bytes(x for x, m in zip(b, mark) if not m))
    return out


@pytest.mark.parametrize("wide,sample", [(4096, 64), (2, 1)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, wide, sample):
    monkeypatch.setattr(occurrences, "SAMPLE", sample)  # 1: frequent anchors are salted
    rows = [r for r in documents() if len(r[1] or "") < 4000]
    docs = document_rows(frame(spark, rows), "doc_id", "text")
    ranges = merged_ranges(suffix_dedup.repeated_ranges(docs, 100, 20000, wide))
    got = without_ranges(docs, ranges, "doc_id").collect()
    want = brute_removed(rows, 100)
    assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) for g in got) == sorted(
        (str(r[0]), *want[(r[0], r[1] or "")]) for r in rows)
    assert any(g.n_removed for g in got)


def test_cut_repeats_keeps_columns_and_valid_text(spark):
    base = "".join(chr(0x100 + k) for k in range(60))  # two bytes each
    rows = [(i, base + "ü" * i, "fr", "s", 1, "r", 5) for i in range(4)] + [(9, None, None, None, None, None, None)]
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[9].text is None
    assert got[3].text == "ü" and got[3].n_chars == 1
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for data in (b"banana", b"a" * 50, bytes(rng.choices(b"ab", k=400)), b"abc" * 90, b"z"):
        d = np.frombuffer(data, np.uint8)
        sa, rank = suffix_dedup.suffix_array(d)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        assert (rank[sa] == np.arange(len(data))).all()
        shared = suffix_dedup.common_prefixes(d, sa, 100)
        for k in range(1, len(sa)):
            a, b = data[sa[k]:], data[sa[k - 1]:]
            assert shared[k] == min(100, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def test_chunks_resist_insertions_and_cover():
    rng = random.Random(2)
    text = sentence(rng, "en", 3000).encode()
    ends = chunk_dedup.cut_points(text)
    assert ends[-1] == len(text) and (np.diff(np.concatenate([[0], ends])) > 0).all()
    assert np.diff(np.concatenate([[0], ends])).max() <= chunk_dedup.LARGEST
    chunks = {text[a:b] for a, b in zip([0, *ends[:-1]], ends)}
    moved = b"inserted words " + text
    ends2 = chunk_dedup.cut_points(moved)
    chunks2 = [moved[a:b] for a, b in zip([0, *ends2[:-1]], ends2)]
    assert sum(c in chunks for c in chunks2) >= len(chunks2) - 3
    assert len(chunk_dedup.cut_points(b"")) == 0


def test_chunk_dedup_equals_brute_force(spark):
    rows = documents()
    got = chunk_dedup.chunk_dedup(frame(spark, rows)).collect()
    seen, want = set(), {}

    def order(d):
        h = xxhash.xxh64_intdigest(d[1].encode(), 42)
        return (d[0] is not None, d[0] or 0, h - (1 << 64) if h >> 63 else h)

    for d in sorted({(r[0], r[1] or "") for r in rows}, key=order):
        data, runs, start = d[1].encode(), [], 0
        for end in chunk_dedup.cut_points(data).tolist():
            c = data[start:end]
            if c in seen:
                if runs and runs[-1][1] == start:
                    runs[-1][1] = end
                else:
                    runs.append([start, end])
            seen.add(c)
            start = end
        runs = [r for r in runs if r[1] - r[0] >= chunk_dedup.LEAST]
        want[d] = (len(data), sum(b - a for a, b in runs), len(runs))
    assert sorted((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans) for g in got) == sorted((str(r[0]), *want[(r[0], r[1] or "")]) for r in rows)
    passages = [g for g in got if g.doc_id is not None and g.doc_id < 60 and g.doc_id % 5 == 0 and g.doc_id]
    assert sum(g.n_removed > 0 for g in passages) >= len(passages) - 1
    assert chunk_dedup.chunk_dedup(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_digest_columns(spark, tmp_path):
    frame(spark, documents()).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in exact_dedup.op2_exact_dedup(spark, str(tmp_path)).where(F.col("doc_id").isNotNull()).collect()}
    assert got[0].text_sha256 == hashlib.sha256(documents()[0][1].encode()).hexdigest()


def test_classes_of_equal_strings_by_brute_force():
    """Every class of equal strings is found whole, the last one in the sort order too."""
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice([[0], [0, 255], [97, 98], list(range(256))])
        contexts = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        contexts += contexts[:3]
        for length in (1, 4, 16, 32):
            want: dict[bytes, set] = {}
            for c, text in enumerate(contexts):
                for p in range(len(text) - length + 1):
                    want.setdefault(text[p:p + length], set()).add((c, p))
            got: dict[int, set] = {}
            for kind, c, p in zip(*suffix_dedup.equal_strings(contexts, length), strict=True):
                got.setdefault(int(kind), set()).add((int(c), int(p)))
            assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
