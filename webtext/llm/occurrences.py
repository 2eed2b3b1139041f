"""First occurrences of keys among very many, by one shuffle and a merge of the salted keys.

Rows are (key, salt, value, doc_id, tag, at, ...): ``value`` tells different
contents of one key apart, (doc_id, tag, at) orders the occurrences. Keys that
a bounded sample shows to be the most frequent carry a salt from 1 to SALTS, the
others salt 0; the salt changes the way of a row, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtext.llm.common import materialise

SALTS, HOT, SAMPLE, SLICE = 64, 1000, 64, 256
ROW = "key long, salt int, value long, doc_id long, tag long, at int, size int"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE documents: a worker holds the rows of one slice at a time."""
    for b in batches:
        for s in range(0, b.num_rows, SLICE):
            yield b.slice(s, SLICE)


def row_batches(b: pa.RecordBatch, doc: np.ndarray, key: np.ndarray, value: np.ndarray, at: np.ndarray, size: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of a batch (doc_id, tag, ...); doc: their places in the batch."""
    tags, ids = b.column(1).to_numpy()[doc], pc.fill_null(b.column(0), 0).to_numpy()[doc]
    # by id and text: copies of one text go to different salts
    mixed = (tags ^ (ids * 0x2545F4914F6CDD1D)) * 0x1B873593
    salt = np.where(np.isin(key, hot), 1 + (mixed >> 40) % SALTS, 0).astype(np.int32)
    for s in range(0, len(doc), 1 << 16):
        e = slice(s, s + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(key[e]), pa.array(salt[e]), pa.array(value[e]), b.column(0).take(pa.array(doc[e])), pa.array(tags[e]), pa.array(at[e].astype(np.int32)), pa.array(size[e].astype(np.int32))], names=COLUMNS)


def frequent_keys(docs: DataFrame, rows_of: Callable[[DataFrame, list[int]], DataFrame]) -> list[int]:
    """At most HOT keys, the most frequent ones of a sample of 1 / SAMPLE of the documents."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(SAMPLE)) == 0)
    top = rows_of(sample, []).groupBy("key").count().where("count >= 8").orderBy(F.desc("count"), "key").limit(HOT)
    return [r[0] for r in top.select("key").collect()]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> later occurrences of their (key, value), with values = 0, and first occurrences.

    ``values`` is the number of different values of the key (1 or more) for
    first occurrences, of which those of lone, unsalted keys are left out.
    A group larger than memory is read as a stream: of its rows only the first
    occurrences are held until it ends.
    """
    held: pa.Table | None = None
    limit = 1 << 16

    def settle(t: pa.Table, ended: bool = True) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Rows to put out, and the first occurrences of a group that has not ended."""
        key, salt, value = (t.column(c).to_numpy() for c in ("key", "salt", "value"))
        new_key = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        new_value = new_key.copy()
        new_value[1:] |= value[1:] != value[:-1]
        group = np.cumsum(new_key) - 1
        kinds = np.bincount(group, new_value).astype(np.int64)[group]
        values = np.where(new_value, kinds, 0)
        first = np.maximum.accumulate(np.where(new_value, np.arange(len(key)), 0))
        doc = t.column("doc_id")
        place = [pc.fill_null(doc, 0).to_numpy(), pc.is_null(doc).to_numpy(), t.column("tag").to_numpy(), t.column("at").to_numpy()]
        again = ~new_value & np.logical_and.reduce([x == x[first] for x in place])  # rows that repeat id and text
        wanted = np.flatnonzero(~again & (~new_value | ((kinds > 1) | (salt > 0)) & ended))
        out = t.take(pa.array(wanted)).append_column("values", pa.array(values[wanted]))
        return out.combine_chunks().to_batches(), t.take(pa.array(np.flatnonzero(new_value)))

    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows < limit:
            continue
        key, salt = held.column("key").to_numpy(), held.column("salt").to_numpy()
        whole = int(np.argmax((key == key[-1]) & (salt == salt[-1])))  # the last group may go on
        if whole:
            yield from settle(held.slice(0, whole))[0]
            held = held.slice(whole).combine_chunks()
        else:
            out, held = settle(held, ended=False)
            yield from out
        limit = max(1 << 16, 2 * held.num_rows)
    if held is not None and held.num_rows:
        yield from settle(held)[0]


def occurrences(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(later, open): later occurrences of a (key, value), and first occurrences of keys with several values."""
    ordered = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "value", "doc_id", "tag", "at")
    found = materialise(ordered.mapInArrow(_settled, ROW + ", values long"), name)
    columns = ["key", "doc_id", "tag", "at", "size"]
    later, lone = found.where("values = 0").select(columns), found.where("values > 1 and salt = 0").select(*columns, "values")
    # salted keys: each salt has put out its first occurrence of every value
    place, local = F.struct("doc_id", "tag", "at", "size"), found.where("values > 0 and salt > 0")
    first = local.groupBy("key", "value").agg(F.min(place).alias("first"))
    beaten = local.join(first, ["key", "value"]).where(~place.eqNullSafe(F.col("first"))).select(columns)
    several = first.groupBy("key").agg(F.count("*").alias("values")).where("values > 1")
    return later.unionByName(beaten), lone.unionByName(first.join(several, "key").select("key", "first.*", "values"))
