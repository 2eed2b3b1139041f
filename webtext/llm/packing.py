"""Packing: documents to sequences of at most ``capacity`` tokens by Karmarkar-Karp multiway differencing.

Each whole text is tokenized and closed by the end id. A document's ids are cut
into pieces of at most ``piece`` ids (whole sequences first), and the piece
table, without ids, is written to the shared folder. Full pieces are sequences
of their own. The other pieces are dealt by row number to groups of
about ``group_windows`` sequences; a group is partitioned into windows by
multiway differencing: the two partial partitions with the largest imbalance
are merged, the largest window of one with the smallest of the other, until
one partition is left. Where a window exceeds the capacity, the window count
rises and the group is partitioned again.

Defined results: a null text counts as empty and gives one piece, the end id;
equal rows are packed each; rows with a null id keep it; every id lies in
exactly one piece; pieces in a sequence are ordered by size, offsets run from
0 without gaps; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm.common import materialise, ship, table

END_ID, CAPACITY = 1, 2048
#: The word pattern of byte-level BPE and its 188 bytes that stand for themselves.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: tiktoken's pattern gives up within a run of about a million white-space characters; runs this long go to tokenizers.
LONG_RUN = 1 << 15
LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Callable[[str], list[int]]:
    """text -> ids by tokenizers itself, special strings taken as text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=4)
def load_encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids of the tokenizer file at ``path``, special strings taken as text.

    A byte-level BPE file whose ids follow its merge order is run by tiktoken
    on the same vocabulary (equal ids, four times the speed), except texts with
    a long run of white space; these and any other file are run by tokenizers.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE":
        other = iter(range(256, 512))
        byte_of = {chr(b) if b in PLAIN_BYTES else chr(next(other)): b for b in range(256)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges):
            import tiktoken

            quick = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return lambda text: load_tokenizer(path)(text) if len(text) >= LONG_RUN and LONG_SPACE.search(text) else quick(text)
    return load_tokenizer(path)


def document_ids(encode: Callable[[str], list[int]], text: str | None, end_id: int = END_ID) -> np.ndarray:
    ids = encode(text) if text else []
    ids.append(end_id)
    return np.array(ids, "<u4")


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, then equal parts of at most ``piece``."""
    whole = n // capacity
    out, start, rest = [(i * capacity, capacity) for i in range(whole)], whole * capacity, n % capacity
    parts = -(-rest // piece)
    for k in range(parts):
        length = rest // parts + (k < rest % parts)
        out.append((start, length))
        start += length
    return out


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Multiway differencing: item numbers by window, sums near equal.

    A partial partition is its window sums, descending and less the smallest,
    with a node for each window; a node is an item or a pair of nodes.
    """
    pairs: list[tuple[int, int]] = []
    n = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = s, i
        heap.append((-int(s), i, sums, nodes))
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        sums, nb = a + b[::-1], nb[::-1]
        nodes = np.maximum(na, nb)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        nodes[both] = np.arange(n + len(pairs), n + len(pairs) + len(both))
        pairs.extend(zip(na[both].tolist(), nb[both].tolist(), strict=True))
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - sums[order[-1]]
        heapq.heappush(heap, (-int(sums[0]), count, sums, nodes[order]))
        count += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo.extend(pairs[x - n])
        out.append(items)
    return out


def windows_of(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises whenever one exceeds it."""
    total, windows = int(sizes.sum()), max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        found = [w for w in difference(sizes, windows) if w]
        most = max((int(sizes[w].sum()) for w in found), default=0)
        if most <= capacity:
            return found
        # room for the excess that this partition showed, and at least one window more
        excess = most - total / windows
        windows = max(windows + 1, min(windows + windows // 8, math.ceil(total / max(1.0, capacity - excess))))


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        for batch in batches:
            names = ("start", "length", "crc", "total")
            row, cols = [], {c: [] for c in names}
            for i, text in enumerate(batch.column(1)):
                ids = document_ids(encode, text.as_py(), end_id)
                for start, length in cuts(len(ids), capacity, piece):
                    row.append(i)
                    for c, v in zip(names, (start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids)), strict=True):
                        cols[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(cols[c], pa.int64()) for c in names)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = CAPACITY, group_windows: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialise(cut_documents(docs, tokenizer, id_col, text_col, capacity, piece).withColumn("row", F.monotonically_increasing_id()), "pieces")
    total = pieces.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / (capacity * group_windows)))

    def windows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", ignore_index=True)
        sizes = part["length"].to_numpy(np.int64)
        window, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for w, items in enumerate(windows_of(sizes, capacity)):
            items = sorted(items, key=lambda i: (-sizes[i], i))
            window[items], offset[items] = w, np.concatenate([[0], np.cumsum(sizes[items])[:-1]])
        # even numbers: windows of groups; odd numbers: full pieces, by row
        return part.assign(sequence_id=2 * ((key[0] << 24) + window), offset=offset)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    small = pieces.where(F.col("length") < capacity).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    # pandas would round ids beside a null one
    held = small.withColumns({"nameless": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    out += ", nameless boolean"
    packed = held.groupBy("group").applyInPandas(lambda key, part: windows(key, part)[[c.split()[0] for c in out.split(", ")]], out)
    packed = packed.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", 2 * F.col("row") + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.select(packed.columns))


def sequence_ids(pieces: DataFrame, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, pad_id: int = 0, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for ids that name one document each.

    Sequences are padded to the capacity, except those whose length is a power of two.
    """
    ship(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_encoder(tokenizer)
        for b in batches:
            ids = [document_ids(encode, t, end_id) for t in b["text"]]
            yield pd.DataFrame({"sequence_id": b["sequence_id"], "offset": b["offset"], "ids": [x[s:s + n].astype(np.int64) for x, s, n in zip(ids, b["start"], b["length"], strict=True)]})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = pieces.join(own, "doc_id").mapInPandas(run, "sequence_id long, offset long, ids array<long>")
    whole = placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
    n = F.size("ids")
    pad = F.when(F.expr("bit_count(size(ids)) = 1"), 0).otherwise(capacity - n)
    return whole.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), pad)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
