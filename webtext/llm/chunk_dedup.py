"""Substring dedup by content-defined chunks.

A gear rolling hash runs over the text's bytes; its 16 bits forget all but the
last 16 bytes. A place whose hash is in the lowest 1 / SPREAD is a candidate,
and a candidate is a cut if no other lies in the SMALLEST bytes before it, so
cuts depend on the bytes around them only: after an insertion the chunks are
the same again from the next cut on. Stretches of more than LARGEST bytes are
cut at that size, counted from the cut before them.

Chunks are compared by a 128-bit digest. Of equal chunks the first stays
(smaller document id, null first; then the text's hash; then the place). Runs
of later chunks of at least ``least`` bytes are removed; shorter runs, such as
a common phrase, stay.

One shuffle brings equal digests together; digests that a bounded sample shows
to be the most frequent are salted, and the salts' first chunks joined after.

Defined results: null texts count as empty; texts shorter than ``least`` lose
nothing; rows that repeat both id and text are one document and get one
result; very long texts are chunked whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm.common import ship, table
from webtext.llm.occurrences import ROW, frequent_keys, occurrences, row_batches, slices
from webtext.llm.ranges import document_rows, merged_ranges, without_ranges

SMALLEST, LARGEST, SPREAD, LEAST = 16, 256, 17, 80
PART = 1 << 20

_GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256).astype(np.uint16)


def gear_hashes(b: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + gear[b[i]] in 16 bits, for all places at once: sums over 2, 4, 8 and 16 bytes."""
    h = _GEAR[b]
    for n in (1, 2, 4, 8):
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint16(n)
        h = longer
    return h


def cut_points(data: bytes) -> np.ndarray:
    """Ends of the chunks of a text."""
    candidates = []
    for start in range(0, len(data), PART):
        before = min(start, 15)
        h = gear_hashes(np.frombuffer(data, np.uint8, min(start + PART, len(data)) - start + before, start - before))[before:]
        candidates.append(np.flatnonzero(h < (1 << 16) // SPREAD) + start + 1)
    c = np.concatenate([[0], *candidates]).astype(np.int64)
    cuts = c[1:][np.diff(c) >= SMALLEST]
    bounds = np.concatenate([[0], cuts[cuts < len(data)], [len(data)]])
    forced = (np.diff(bounds) - 1) // LARGEST  # more cuts in each stretch
    if forced.any():
        wide = np.flatnonzero(forced)
        bounds = np.sort(np.concatenate([bounds, *(bounds[i] + LARGEST * np.arange(1, forced[i] + 1) for i in wide)]))
    return bounds[1:] if len(data) else bounds[:0]


def chunk_rows(rows: DataFrame, hot: list[int]) -> DataFrame:
    """Every chunk: key and value are the halves of its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(sorted(hot), np.int64)
        for b in slices(batches):
            doc, at, size, digests = [], [], [], []
            for i, data in enumerate(b.column(2)):
                data = data.as_py()
                ends = cut_points(data)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                doc.append(np.full(len(ends), i))
                at.append(starts)
                size.append(ends - starts)
                digests.extend([xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            if digests:
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield from row_batches(b, np.concatenate(doc), np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), np.concatenate(at), np.concatenate(size), frequent)

    return rows.mapInArrow(run, ROW)


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, ranges, kept (the remaining bytes)."""
    ship(docs)
    rows = document_rows(docs, id_col, text_col)
    later, _ = occurrences(chunk_rows(rows, frequent_keys(rows, chunk_rows)), "chunks")
    ranges = later.select("doc_id", "tag", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("size")).cast("long").alias("stop"))
    return without_ranges(rows, merged_ranges(ranges, least), id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
