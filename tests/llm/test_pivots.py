"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from webtext.llm import pivots

SCHEMA = "vec_id long, embedding array<double>, label int, row string, part int, vec string, leader int"


def table_of(spark, ids, vectors, labels):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None if k is None else int(k), "r", 1, "v", 3) for i, v, k in zip(ids, vectors, labels, strict=True)], SCHEMA)


def brute(ids, vectors, labels, least):
    """(id, n_links, component, kept) of every row, by all pairs of rows."""
    n = len(ids)
    good = [v is not None and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v, k in zip(vectors, labels, strict=True)]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if g else None for v, g in zip(vectors, good, strict=True)]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            near[i, j] = i != j and good[i] and good[j] and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            m = min([label[i]] + [label[j] for j in np.flatnonzero(near[i])])
            changed |= m != label[i]
            label[i] = m
    out = []
    for i in range(n):
        known = [ids[j] for j in range(n) if label[j] == label[i] and ids[j] is not None]
        comp = min(known) if known else None
        out.append((ids[i], int(near[i].sum()), comp, ids[i] == comp))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=str)


def cluster(rng, centre, n, noise):
    return centre + noise * rng.normal(size=(n, len(centre))) / np.sqrt(len(centre))


@pytest.mark.parametrize("chunk,dense", [(1024, 8), (16, 2)])
def test_against_all_pairs(spark, monkeypatch, chunk, dense):
    monkeypatch.setattr(pivots, "CHUNK", chunk)
    monkeypatch.setattr(pivots, "DENSE", dense)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=24)
    parts = [rng.normal(size=(150, 24)), cluster(rng, hot, 120, 0.1 * np.linalg.norm(hot))]
    for noise in (0.05, 0.2, 0.35, 0.5):
        centre = rng.normal(size=24)
        parts.append(cluster(rng, centre, 12, noise * np.linalg.norm(centre)))
    vectors = [list(v) for v in np.concatenate(parts)]
    labels = [int(x) for x in rng.integers(0, 2, len(vectors))]
    labels[150:270] = [1] * 120
    ids = [int(x) for x in rng.permutation(len(vectors)) + 2**53]
    vectors += [vectors[0], vectors[0], [3 * x for x in vectors[1]], vectors[160], None, [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, vectors[2], vectors[2][:20], vectors[2][:20], [1e200] * 24, [1e200] * 24, [], vectors[3], [1e-300] * 24]
    labels += [labels[0], labels[0], labels[1], 1, 0, 0, 0, 0, 0, None, 0, 0, 0, 0, 0, labels[3], 0]
    ids += [ids[0], 5, 6, None, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, None, 18]
    frame = table_of(spark, ids, vectors, labels).repartition(4)
    want = brute(ids, vectors, labels, 0.93)
    assert rows_of(pivots.near_duplicates(frame, listed=16, shared=1)) == want  # all vectors meet: exact
    got = rows_of(pivots.near_duplicates(frame))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) and np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.95
    assert pivots.near_duplicates(frame.limit(0)).count() == 0


def test_query_and_links_at_the_threshold(spark, tmp_path):
    """Pairs in 64 dimensions just above the threshold are found, pairs just below it are not linked."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = np.where(np.arange(600) % 2 == 0, 0.9301, 0.9299)[:, None]
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * side])
    frame = table_of(spark, range(1200), both, [1] * 1200)
    frame.selectExpr("vec_id", "cast(embedding as array<float>) embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in pivots.op13_embedding_near_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == 1200
    found = [got[i + 600].component_id == i and got[i].n_links == got[i + 600].n_links == 1 for i in range(0, 600, 2)]
    assert np.mean(found) >= 0.98
    assert all(got[i].n_links == got[i + 600].n_links == 0 and got[i].kept and got[i + 600].kept for i in range(1, 600, 2))


def test_long_lists_are_split_without_loss(spark):
    rng = np.random.default_rng(2)
    members = spark.createDataFrame([(int(i), int(i), "p", [int(x) for x in rng.permutation(12)]) for i in range(60)], "row long, class long, part string, perm array<short>")
    whole, split = ({tuple(r) for r in pivots.candidates(members, longest).collect()} for longest in (512, 4))
    assert whole == split and len(whole) == 60 * 59 // 2
