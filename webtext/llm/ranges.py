"""Byte ranges of documents: named, merged, and cut from the texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtext.llm.common import whole_row

RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, data): the tag, a hash of the text, tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("data"))


def merged_ranges(ranges: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, tag, ranges): disjoint ranges, in order, of every document that has any of at least ``least`` bytes."""
    listed = ranges.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.column(2):
                merged: list[list[int]] = []
                for x in r.as_py():
                    if merged and x["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["stop"])
                    else:
                        merged.append([x["start"], x["stop"]])
                out.append([{"start": s, "stop": e} for s, e in merged if e - s >= least])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, RANGES)], names=["doc_id", "tag", "ranges"])

    return listed.mapInArrow(run, "doc_id long, tag long, ranges array<struct<start:long,stop:long>>").where("size(ranges) > 0")


def _kept(data: bytes, ranges: list[dict] | None) -> bytes:
    out, done = [], 0
    for r in ranges or []:
        out.append(data[done:r["start"]])
        done = r["stop"]
    return b"".join([*out, data[done:]])


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    same = F.col("m.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("m.tag") == F.col("r.tag"))
    return rows.alias("r").join(ranges.alias("m"), same, "left").select("r.*", "m.ranges")


def without_ranges(rows: DataFrame, ranges: DataFrame, id_col: str) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, ranges, kept (the remaining bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, kept, found = [], [], []
            for data, r in zip(b.column(1), b.column(2), strict=True):
                data, r = data.as_py(), r.as_py() or []
                sizes.append(len(data))
                found.append([{"start": x["start"], "stop": min(x["stop"], len(data))} for x in r])
                kept.append(_kept(data, r))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, RANGES), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "ranges", "kept"])

    done = with_ranges(rows, ranges).select("doc_id", "data", "ranges").mapInArrow(cut, "doc_id long, n_bytes long, ranges array<struct<start:long,stop:long>>, kept binary")
    return done.select(F.col("doc_id").alias(id_col), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("ranges").cast("long").alias("n_spans"), "ranges", "kept")


def cut_texts(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents without their ranges, all columns kept.

    A range is narrowed to whole characters, so that the rest is valid UTF-8;
    ``n_chars`` is set anew where the table has it.
    """
    keyed = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    joined = with_ranges(keyed, ranges).select("row", F.when(F.col("ranges").isNotNull(), text).cast("binary").alias("data"), "ranges")  # whole texts don't go to Python

    @F.pandas_udf("string")
    def cut(data: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _kept(d, [_narrow(d, r) for r in x]).decode() for d, x in zip(data, ranges, strict=True)])

    text = F.when(F.col("ranges").isNull(), F.col(f"row.`{text_col}`")).otherwise(cut("data", "ranges"))
    out = joined.withColumn("cut", text)
    columns = [F.col("cut").alias(c) if c == text_col else F.length("cut").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)


def _narrow(data: bytes, r: dict) -> dict:
    start, stop = r["start"], r["stop"]
    while start < stop and data[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop -= 1
    return {"start": start, "stop": stop}
