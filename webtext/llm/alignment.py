"""Cross-tokenizer alignment: groups of tokens that two tokenizers cut alike, by galloping intersection.

Tokenizer A encodes space + text, tokenizer B the text (it adds the space
itself), so both cut the same bytes. A tokenizer's byte offsets where tokens
end are an increasing list. In every text the shorter list drives the search:
from a guess in proportion an exponential search brackets each of its ends in the longer list
and a binary search finds its rank there. Ends in both lists cut the text into groups;
the difference of two neighbouring ranks is the range of tokens that a
token overlaps, which gives the linked pairs.

Texts are aligned in blocks of about ``BLOCK_BYTES`` whole texts. A block is
one row of a written table: the figures of its documents, its distinct id pairs with their
numbers, and its links as references to them. The pairs of all blocks are
summed, each pair's count (and whether it is the highest of its B id) goes back to
the blocks that hold it, and the blocks sum them over the links of every
document. A pair is one row per block, however frequent it is, and a block's rows
are bounded by its bytes.

Defined results: texts that are null, empty, or whose joined tokens of A or B
differ from space + text have no tokens, zeros and an empty ``groups_sha256``;
special strings inside a text are plain text; every row of the table gives one
row, repeated ids and null ids too; a text longer than a block is a block of its
own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtext.llm.common import materialise, ship, table
from webtext.llm.packing import PLAIN_BYTES, load_encoder

BLOCK_BYTES, BLOCK_DOCS = 1 << 21, 1 << 14
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
BLOCKS = "block long, doc_ids array<long>, " + ", ".join(f"{c} array<long>" for c in FIGURES) + ", groups_sha256 array<string>, pairs binary, numbers binary, links binary"
RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """Token bytes of a tokenizer, and its ids in decimal followed by a mark."""

    def __init__(self, encode, token_bytes: list[bytes], marks: tuple[bytes, bytes]):
        self.encode, self.bytes = encode, token_bytes
        self.sizes = np.array([len(b) for b in token_bytes], np.int64)
        # entry 2 * id: the id inside a group; entry 2 * id + 1: the last one of a group
        self.written = np.array([b"%d%s" % (i, m) for i in range(len(token_bytes)) for m in marks], object)


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> Vocabulary:
    """Tokenizer A: a byte-level file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    other = iter(range(256, 512))
    byte_of = {chr(b) if b in PLAIN_BYTES else chr(next(other)): b for b in range(256)}
    entries = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    decoded = [bytes(byte_of[c] for c in entries[i]) if i in entries else b"" for i in range(max(entries) + 1)]
    return Vocabulary(load_encoder(path), decoded, (b",", b"|"))


@functools.lru_cache(maxsize=4)
def sentence_pieces(path: str) -> Vocabulary:
    """Tokenizer B: a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    decoded = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    return Vocabulary(model.encode, decoded, (b",", b";"))


def gallop(ends: np.ndarray, into: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of ``ends`` the number of smaller elements of the sorted list ``into``, searched outwards from ``start``.

    Steps double until they bracket the place; a binary search ends it.
    """
    top = len(into)
    into = np.append(into, np.iinfo(np.int64).max)
    low, high = np.minimum(start, top), np.minimum(start, top)
    # into[low - 1] < end <= into[high] holds for those that are no longer active
    right = np.flatnonzero(into[high] < ends)
    left = np.flatnonzero((low > 0) & (into[low - 1] >= ends))
    step = 1
    while len(right):
        low[right] = high[right] + 1
        high[right] = np.minimum(high[right] + step, top)
        right = right[into[high[right]] < ends[right]]
        step *= 2
    step = 1
    while len(left):
        high[left] = low[left] - 1
        low[left] = np.maximum(low[left] - step, 0)
        left = left[(low[left] > 0) & (into[low[left] - 1] >= ends[left])]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = into[middle] < ends[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - stop + size, size)


def intersect(ends: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray], number: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Common ends and overlapping tokens of two lists of ends of many texts.

    ``ends`` are offsets in all texts joined; a text's tokens in list s are
    first[s][d] and the number[s][d] - 1 after it. Returns a mask of the common ends of each list,
    and the token numbers (in A, in B) of all overlapping pairs.
    """
    common = tuple(np.zeros(len(e), bool) for e in ends)
    pairs: list[list[np.ndarray]] = [[], []]
    for short in (0, 1):
        long = 1 - short
        driven = np.flatnonzero((number[short] > 0) & ((number[0] <= number[1]) == (short == 0)))
        size, here, there = number[short][driven], first[short][driven], first[long][driven]
        token = _ranges(here, size)
        if not len(token):
            continue
        text = np.repeat(np.arange(len(driven)), size)
        guess = there[text] + (token - here[text]) * number[long][driven][text] // size[text]
        rank = gallop(ends[short][token], ends[long], guess)
        same = ends[long][rank] == ends[short][token]
        common[short][token[same]] = True
        common[long][rank[same]] = True
        # a token overlaps the other list from the place after the previous end up to its own end's rank
        begin = np.empty_like(rank)
        begin[1:] = rank[:-1] + same[:-1]
        begin[np.cumsum(size) - size] = there
        overlapped = rank - begin + 1
        pairs[short].append(np.repeat(token, overlapped))
        pairs[long].append(_ranges(begin, overlapped))
    return common, tuple(np.concatenate(p) if p else np.empty(0, np.int64) for p in pairs)


def _per_text(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, number[d] of them for text d."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    stop = np.cumsum(number)
    return total[stop] - total[stop - number]


def align_block(texts: list[str | None], a: Vocabulary, b: Vocabulary) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Figures of every text, and the linked (A, B) ids of all texts in order."""
    ids: tuple[list, list] = ([], [])
    for text in texts:
        own = (a.encode(" " + text), b.encode(text)) if text else ([], [])
        if text:
            whole = (" " + text).encode()
            if any(b"".join(map(v.bytes.__getitem__, x)) != whole for v, x in zip((a, b), own, strict=True)):
                own = ([], [])
        for side in (0, 1):
            ids[side].append(own[side])
    number = tuple(np.array([len(x) for x in side], np.int64) for side in ids)
    first = tuple(np.cumsum(n) - n for n in number)
    tokens = tuple(np.fromiter(itertools.chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(ids, number, strict=True))
    ends = tuple(np.cumsum(v.sizes[t]) for v, t in zip((a, b), tokens, strict=True))
    common, (link_a, link_b) = intersect(ends, first, number)

    # A's tokens of a group are written before B's: places of all tokens in the joined groups
    group = [np.cumsum(c) - c for c in common]
    last = [np.flatnonzero(c) for c in common]
    place_a = np.arange(len(tokens[0])) + np.concatenate([[0], last[1] + 1])[group[0]]
    place_b = np.arange(len(tokens[1])) + (last[0] + 1)[group[1]]
    written = np.empty(len(place_a) + len(place_b), object)
    written[place_a] = a.written[2 * tokens[0] + common[0]]
    written[place_b] = b.written[2 * tokens[1] + common[1]]
    start = first[0] + first[1]
    digests = [hashlib.sha256(b"".join(written[s:s + n].tolist())[:-1]).hexdigest() if n else "" for s, n in zip(start.tolist(), (number[0] + number[1]).tolist(), strict=True)]
    # links come by the driving side; texts keep their order in the list of their A tokens
    order = np.argsort(link_a, kind="stable")
    link_a, link_b = link_a[order], link_b[order]
    n_links = np.diff(np.searchsorted(link_a, np.append(first[0], len(tokens[0]))))
    figures = dict(zip(FIGURES, (number[0].tolist(), number[1].tolist(), _per_text(common[0], number[0]).tolist(), n_links.tolist()), strict=True))
    return {**figures, "groups_sha256": digests}, tokens[0][link_a], tokens[1][link_b]


def _packed(values: np.ndarray) -> bytes:
    """zstd bytes of whole numbers, after their width and their count."""
    width = np.min_scalar_type(int(values.max()) if len(values) else 0)
    raw = values.astype(width).tobytes()
    return bytes([width.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(stored: bytes) -> np.ndarray:
    raw = pa.decompress(stored[9:], int.from_bytes(stored[1:9], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, f"u{stored[0]}").astype(np.int64)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """BLOCKS of all documents, written to the shared folder."""
    ship(docs)
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in FIGURES), ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.binary()), ("numbers", pa.binary()), ("links", pa.binary())])

    def block(number: int, doc_ids: list, texts: list) -> pa.RecordBatch:
        figures, link_a, link_b = align_block(texts, byte_level(a_path), sentence_pieces(b_path))
        links, pairs = pd.factorize(link_a << 32 | link_b)
        row = {"block": number, "doc_ids": doc_ids, **figures, "pairs": _packed(pairs), "numbers": _packed(np.bincount(links, minlength=len(pairs))), "links": _packed(links)}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, doc_ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(text or "")
                if texts and (held + size > block_bytes or len(texts) >= BLOCK_DOCS):
                    yield block(number, doc_ids, texts)
                    number, held, doc_ids, texts = number + 1, 0, [], []
                held += size
                doc_ids.append(doc_id)
                texts.append(text)
        if texts:
            yield block(number, doc_ids, texts)

    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCKS), "aligned-blocks")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): the linked id pairs of every block, A's id in the upper half of ``pair``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, numbers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                p, n = _unpacked(pairs), _unpacked(numbers)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), number, np.int64)), pa.array(p), pa.array(n)], names=["block", "pair", "n"])

    return blocks.select("block", "pairs", "numbers").mapInArrow(rows, "block long, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): links of every pair in the corpus; best: no other pair of its B id has more.

    The rows of one B id are at most the entries of vocabulary A.
    """
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    same_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(same_b))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document (RESULT)."""
    blocks = aligned_blocks(docs, a_path, b_path, id_col, text_col, block_bytes)
    pairs = block_pairs(blocks)
    answers = pairs.select("block", "pair").join(pair_counts(pairs), "pair")

    def finish(block: pa.Table, known: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair)
        place = order[np.searchsorted(pair[order], _unpacked(row["pairs"]))]
        links, number = _unpacked(row["links"]), np.array(row["n_links"], np.int64)
        count, best = known.column("count").to_numpy()[place], known.column("best").to_numpy(zero_copy_only=False)[place]
        columns = [pa.array(row["doc_ids"], pa.int64()), *(pa.array(row[c], pa.int64()) for c in FIGURES), pa.array(_per_text(best[links], number)), pa.array(_per_text(count[links], number)), pa.array(row["groups_sha256"], pa.string())]
        return pa.table(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, RESULT)
    return out.withColumnRenamed("doc_id", id_col)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
