"""Ids above 2**53 beside null ids stay exact, hot keys are spread and streamed, the cuckoo index grows."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import documents, frame, sentence
from test_dedup import brute_removed

from webtext.llm import exact_dedup, occurrences, packing, suffix_dedup
from webtext.llm.common import table

BIG = [2**53 + 1, 2**53 + 3, 2**63 - 1, 2**63 - 3, None, -(2**63), 2**53 + 1]


def rows_with_big_ids():
    import random

    rng = random.Random(3)
    shared, rows = sentence(rng, "en", 40), []
    for k, i in enumerate(BIG * 3):
        rows.append((i, shared + sentence(rng, "fr", 10) if k % 3 else shared, "en", "s", 1, "r", 5))
    return rows


def write(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_exact_dedup_keeps_ids(spark, tmp_path):
    rows = rows_with_big_ids()
    got = exact_dedup.op2_exact_dedup(spark, write(spark, tmp_path, rows)).collect()
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text, []).append(i)
    want = [(i, max((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t, *_ in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got)
    assert sum(r.kept for r in got) == len(groups) and all(r.keep_id == r.doc_id for r in got if r.kept)


def test_suffix_dedup_keeps_ids(spark, tmp_path):
    rows = rows_with_big_ids()
    want = brute_removed(rows, 100)
    got = suffix_dedup.op9_suffix_array_dedup(spark, write(spark, tmp_path, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in got) == sorted((str(r[0]), *want[(r[0], r[1])][:3]) for r in rows)
    assert sum(r.n_removed > 100 for r in got) > 10


def test_packing_keeps_ids_and_bounds_padding(spark, tmp_path):
    rows = rows_with_big_ids() + documents()
    got = packing.op10_packing(spark, write(spark, tmp_path, rows)).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    total, length = {}, {}
    for i, text, *_ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        total[i] = total.get(i, 0) + n
    for r in got:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == total
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    least = -(-sum(total.values()) // 2048)
    assert len(sequences) <= least + 2  # near-full windows


def test_index_of_an_empty_table_and_growth(spark):
    digests = exact_dedup.digests_of(frame(spark, documents()))
    empty = exact_dedup.build_index(digests.limit(0))
    assert exact_dedup.live_digests(exact_dedup.update_index(empty, deleted=digests)).count() == 0
    grown = exact_dedup.update_index(empty, inserted=digests, keys_per_shard=8)
    assert grown.count() > 4  # dealt to more shards
    want = {(bytes(r.digest), r.keep_id, r.group_size) for r in exact_dedup.live_digests(exact_dedup.build_index(digests)).collect()}
    assert {(bytes(r.digest), r.keep_id, r.group_size) for r in exact_dedup.live_digests(grown).collect()} == want


def test_copies_of_a_hot_text_get_all_salts():
    n = 1000
    b = pa.RecordBatch.from_arrays([pa.array([None, *range(1, n)], pa.int64()), pa.array(np.full(n, 12345678901))], names=["doc_id", "tag"])
    one = np.zeros(n, np.int64)
    salts = [s for out in occurrences.row_batches(b, np.arange(n), one + 7, one, one, one, np.array([7])) for s in out.column("salt").to_pylist()]
    assert min(salts) >= 1 and len(set(salts)) == occurrences.SALTS


@pytest.mark.parametrize("kinds", [1, 3])
def test_a_large_group_is_settled_as_a_stream(kinds):
    """One key with many rows in small batches: its first occurrences come out once, all others as later ones."""
    n = 1 << 18
    value = np.sort(np.arange(n) % kinds)
    held = []

    def batches():
        for s in range(0, n, 1 << 13):
            e = slice(s, s + (1 << 13))
            m = len(value[e])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 7)), pa.array(np.zeros(m, np.int32)), pa.array(value[e]), pa.array(np.arange(n)[e]), pa.array(np.arange(n)[e]), pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, np.int32))], names=occurrences.COLUMNS)

    for out in occurrences._settled(batches()):
        held.append(out.to_pandas())
        assert len(held[-1]) <= 1 << 18
    values = np.concatenate([x["values"] for x in held])
    assert (values == 0).sum() == n - kinds
    assert (values > 0).sum() == (kinds if kinds > 1 else 0) and set(values[values > 0]) <= {kinds}


def test_tables_can_be_read(spark, tmp_path):
    assert table(spark, write(spark, tmp_path, documents()), "documents").count() == len(documents())
