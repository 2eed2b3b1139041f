"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has the majority bits of the XXH64 hashes of its word
shingles. Documents with equal fingerprints are one node. For a largest
distance t the 64 bits are cut into a ring of t + 1 segments. By the
pigeonring principle two fingerprints within t have a start segment from which
every chain of l segments differs in at most l * t / (t + 1) bits, that is in
l - 1: the first segment agrees, the first two differ in one bit at most, and
so on. The first two segments of every start make the bucket key: each
fingerprint stands in its own buckets, and one with an even second segment also
in those of the one-bit neighbours of that segment, so every pair that meets
the first two budgets shares a bucket. In a bucket the chain budgets prune pairs before the full Hamming
check, and a spanning forest of the links goes out, not all pairs.

Buckets of more than ``bucket_rows`` rows take another exact way: each of
their fingerprints is sent to all points within half the distance, and the
fingerprints that meet at a point are linked to the smallest of them. This
grows with the fingerprints, not with their pairs.

Defined results: null and empty texts, and texts of white space only, have
fingerprint zero and are linked like others; a text of fewer words than a
shingle is one shingle; long texts are read whole; component_id is the
smallest id of the component (null if all ids are null); repeated rows stay; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm.common import keep_rows, materialise, ship, table
from webtext.llm.components import connected_components

SEED = 42


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64 majority bits; ``bytes.lower`` and ``bytes.split`` touch A-Z and the six ASCII white spaces only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))  # word i starts at ends[i] and ends before ends[i + 1] - 1
    spans = zip(ends, ends[shingle:]) if len(words) >= shingle else [(0, len(joined) + 1)]
    count, ones, digest = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e - 1], SEED) for s, e in spans), "<u8")
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, digest, fp): the fingerprint as a signed long, and the text's SHA-256; written to the shared folder."""
    ship(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "digest", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"))
    return materialise(rows.mapInArrow(run, "id long, digest binary, fp long"), "fingerprints")


def ring(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the distance + 1 segments."""
    m = distance + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return list(zip(accumulate(widths, initial=0), widths))


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def bucket_rows_of(nodes: DataFrame, distance: int) -> DataFrame:
    """(key, fp): the buckets of every fingerprint."""
    parts, arrays = ring(distance), []
    for i, (first, width) in enumerate(parts):
        nxt, nxt_width = parts[(i + 1) % len(parts)]
        head = F.shiftleft(F.lit(i).cast("long"), 56).bitwiseOR(F.shiftleft(_segment(F.col("fp"), first, width), nxt_width)) if width + nxt_width <= 56 else F.xxhash64(F.lit(i), _segment(F.col("fp"), first, width))
        second = _segment(F.col("fp"), nxt, nxt_width)
        join = (lambda s, head=head, fits=width + nxt_width <= 56: head.bitwiseOR(s) if fits else F.xxhash64(head, s))
        flips = F.array(*[join(second.bitwiseXOR(F.lit(1 << k))) for k in range(nxt_width)])
        none = F.expr("cast(array() as array<bigint>)")
        arrays.append(F.concat(F.array(join(second)), F.when(F.bit_count(second) % 2 == 0, flips).otherwise(none)))
    return nodes.select("fp", F.explode(F.concat(*arrays)).alias("key"))


def chain_holds(x: np.ndarray, distance: int) -> np.ndarray:
    """Whether some start of the ring has all its chain sums within budget; x: differing bits."""
    parts = ring(distance)
    diffs = [np.bitwise_count((x >> np.uint64(f)) & np.uint64((1 << w) - 1)) for f, w in parts]
    ok = np.zeros(len(x), bool)
    for i in range(len(parts)):
        total, good = np.zeros(len(x), np.uint8), np.ones(len(x), bool)
        for l in range(len(parts) - 1):
            total = total + diffs[(i + l) % len(parts)]
            good &= total <= l
        ok |= good
    return ok


def linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Pairs within the distance: the chain budgets first, then the full Hamming check."""
    x = a ^ b
    out = chain_holds(x, distance)
    out[out] = np.bitwise_count(x[out]) <= distance
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest in every bucket; keys are sorted, fps uint64."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    few = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    for d in range(1, 8):
        at = np.flatnonzero(few[d:] & (keys[d:] == keys[:-d]))
        at = at[linked(fps[at], fps[at + d], distance)]
        left.append(fps[at])
        right.append(fps[at + d])
    for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        rest = fps[s:s + n]
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                fp = todo.pop()
                near = linked(np.full(len(rest), fp), rest, distance)
                left.append(np.full(int(near.sum()), fp))
                right.append(rest[near])
                todo.extend(rest[near])
                rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def _stream_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0  # the last bucket may go on
            if whole > 1:
                yield links(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys) > 1:
            yield links(keys, fps)

    return run


def ball_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links by shared points within half the distance; for crowded buckets."""
    inner, outer = distance // 2, distance - distance // 2
    level = nodes.select("fp", F.col("fp").alias("point"), F.lit(-1).alias("last"), F.lit(0).alias("radius"))
    points = level
    for r in range(1, outer + 1):  # one more bit, above the last
        level = level.where("last < 63").select("fp", "point", F.explode(F.sequence(F.col("last") + 1, F.lit(63))).alias("last"))
        level = level.select("fp", F.col("point").bitwiseXOR(F.expr("shiftleft(1L, last)")).alias("point"), "last", F.lit(r).alias("radius"))
        points = points.unionByName(level)
    hubs = points.where(F.col("radius") <= inner).groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n"))
    return points.join(hubs, "point").where("fp <> hub").select(F.col("fp").alias("src"), F.col("hub").alias("dst")).distinct()


def links_of(nodes: DataFrame, distance: int, bucket_rows: int = 4096) -> DataFrame:
    """(src, dst): links whose components are those of all pairs within the distance."""
    if distance < 1:
        return nodes.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).where("false")
    rows = bucket_rows_of(nodes, distance)
    crowded = materialise(rows.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"), "crowded-keys")
    if crowded.isEmpty():
        found = rows
    else:
        found = rows.join(crowded, "key", "left_anti")
    links = found.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_stream_links(distance), "src long, dst long")
    if crowded.isEmpty():
        return links
    packed = materialise(rows.join(crowded, "key", "left_semi").select("fp").distinct(), "crowded-nodes")
    return links.unionByName(ball_links(packed, distance))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """One row per document: id, digest, fp, the component's root fingerprint and its component_id."""
    rows = fingerprints(docs, id_col, text_col, shingle)
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(links_of(nodes.select("fp"), distance, bucket_rows))
    # nodes with links get their component; the others are their own
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = materialise(member.join(least, "root").select("fp", "root", "component_id"), "members")
    return rows.join(member, "fp").select(F.col("id").alias(id_col), "digest", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One document of every component stays, the one of the smallest id, with all its columns."""
    found = near_duplicates(docs, id_col, text_col, shingle, distance).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    # of several rows of that id, the one of the smallest digest
    chosen = found.groupBy("root").agg(F.min("digest").alias("digest"), F.min(id_col).alias("id"))
    return keep_rows(docs, chosen, id_col, text_col)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
