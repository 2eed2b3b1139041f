"""Prefix trie against a plain version with a dictionary of prefixes, and its reference SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from webtext.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, node int, x int"


def plain(rows):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends) of every node, by the definition."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends, made = {}, {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(convs.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(made[c]) + 1):
            members.setdefault(made[c][:d], []).append(c)
        ends.setdefault(made[c], []).append(c)
    least = {p: min(m) for p, m in members.items()}
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def conversations(seed=1):
    rng = random.Random(seed)
    said = ["hi", "hi there", "", "a b\tc d", "é\nx", None]
    rows = []
    for c in [*range(60), -3, -20, -25, 2**53 + 1, 2**63 - 1, 10**6, 10**6 + 7]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(said)))
    rows += [(200, t, "user", f"long {t}") for t in range(150)] + [(c, t, "user", f"long {t}" if t < 20 * (c - 200) else f"own {c} {t}") for c in range(201, 206) for t in range(120)]
    rows += [(300, None, "user", "null turn"), (300, 1, None, None), (300, 1, "user", "tie"), (300, 1, "user", "tie"), (300, 1, "a", "usertie"), (None, 1, "user", "x"), rows[0], rows[0], (301, 5, "user", "w " * 20000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("large", [prefix_trie.LARGE, 40])
def test_against_plain_version(spark, large):
    rows = conversations()
    made = prefix_trie.rebuilt(prefix_trie.ordered_turns(frame(spark, rows).repartition(5)))
    got = prefix_trie.trie(*made, large=large).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_empty_table(spark):
    empty = prefix_trie.ordered_turns(frame(spark, conversations()[:1]).limit(0))
    assert prefix_trie.trie(*prefix_trie.rebuilt(empty)).count() == 0


def test_query_and_its_sql(spark, tmp_path):
    rows = [r for r in conversations(3) if r[0] is None or r[0] < 204]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = prefix_trie.op11_conversation_prefix_trie(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(prefix_trie.ORACLE_SQL)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(want.fetchall(), key=lambda r: r[:2])
    assert sorted([tuple(r) for r in got.select(*names).collect()], key=lambda r: r[:2]) == want == plain(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_rolled_up(shape):
    n, rng = 300, random.Random(4)
    parent = [-1] + [{"chain": i - 1, "star": 0, "random": rng.randrange(i), "caterpillar": i - 1 - (i % 2 == 0)}[shape] for i in range(1, n)]
    depth, size, value = [0] * n, [1] * n, np.array([[rng.randrange(9), i] for i in range(n)])
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    want = value.copy()
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        want[parent[i]] += want[i]
    order = rng.sample(range(n), n)
    part = pd.DataFrame({"conv_id": range(n), "depth": depth, "parent_conv_id": [max(p, 0) for p in parent], "size": size, "n_leaves": value[:, 0], "saved_tokens": value[:, 1], "top_conv": 0, "top_depth": 0}).iloc[order]
    assert (prefix_trie.rolled_up(part) == want[order]).all()
