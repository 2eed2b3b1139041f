"""Substring dedup with suffix arrays: every byte inside a string of ``length`` bytes that also starts earlier goes.

Anchors. In every ``length`` bytes the leftmost smallest hash of a GRAM-byte
gram is an anchor. Equal strings of that length have the same anchor at the
same place, so they are found among the occurrences of one anchor, within its
context: the anchor and the bytes up to ``length`` - GRAM to both sides.

Occurrences. One shuffle brings the occurrences of an anchor together, sorted
by context digest and document order. Anchors that occur once are done. Of
equal contexts all but the first are covered by the first one. Anchors that a
bounded sample of the documents shows to be the most frequent are salted: each
salt yields its first occurrences, and a second step joins the salts.

Suffix arrays. Where an anchor has different contexts, the first of each is
fetched from the text and dealt to a shard with the others of the anchor. A
shard sorts its suffixes by Larsson-Sadakane refinement (numpy sorts of packed
rank pairs, sorted groups left alone), takes the common prefixes of neighbours
by Kasai's rule, and so gets the classes of equal strings; in each class the
earliest start stays. An anchor with more than ``WIDE`` different contexts (a
common line, say) is replaced by STEPS longer ones, the anchor with bytes
beside it, of which every repeated string holds one; contexts alone on a longer
anchor are done. A longer anchor that still has more than ``WIDE`` contexts is
dealt to several shards; these put out their classes' strings, and the shards
are merged by binary search in the sorted strings of all.

Order: smaller document id first (null before all), then the text's hash
(for ids that several rows share), then the start. Rows that repeat both id
and text are one document and get one result. Null texts count as empty;
matches never cross documents; an empty table gives no rows; other columns
are only passed on by ``cut_repeats``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm.common import materialise, ship, table
from webtext.llm.occurrences import ROW, frequent_keys, occurrences, row_batches, slices
from webtext.llm.ranges import cut_texts, document_rows, merged_ranges, without_ranges

LENGTH, GRAM = 100, 32
PART = 1 << 20  # bytes of a text whose anchors are found at a time
INDEX_BITS = 21  # positions of one suffix array
BLOCK = 1 << 17  # bytes sorted at once, but for one anchor's: its arrays stay in the cores' caches
WIDE = 4096  # contexts of an anchor in one shard
STEPS = 4

_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` (a power of two) bytes from every place."""
    h, n, base = _TABLE[b], 1, _BASE
    while n < gram:
        h = h[:-n] * np.uint64(base) + h[n:]
        n, base = 2 * n, base * base % 2**64
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[:len(x) - (width - n)], x[width - n:]) if width > n else x


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text."""
    places, hashes, last = [], [], -1
    windows = len(data) - length + 1
    for start in range(0, max(windows, 0), PART):
        end = min(start + PART, windows) + length - 1
        h = gram_hashes(np.frombuffer(data, np.uint8, end - start, start))
        order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(order, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = at[np.concatenate([[at[0] + start != last], at[1:] != at[:-1]])]
        places.append(at + start)
        hashes.append(h[at])
        last = int(at[-1]) + start if len(at) else last
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))


def context(data: bytes, at: int, length: int = LENGTH) -> tuple[bytes, int]:
    """The context of the anchor at a place, and the anchor's place in it."""
    left = min(at, length - GRAM)
    return data[at - left:at + length], left


def longer_anchors(piece: bytes, left: int, length: int = LENGTH) -> list[int]:
    """Keys of an anchor together with bytes beside it.

    A string of ``length`` bytes with l bytes before the anchor holds, for the
    step that l falls in, the least l of the step and the bytes that are left
    for the other side. So equal strings share the key of their step.
    """
    step, right, out = (length - GRAM) // STEPS, len(piece) - left - GRAM, []
    for k in range(STEPS):
        before, after = k * step, length - GRAM - (k + 1) * step if k < STEPS - 1 else 0
        if left >= before and right >= after:
            key = xxhash.xxh3_64_intdigest(piece[left - before:left + GRAM + after], k)
            out.append(key - (1 << 64) if key >> 63 else key)
    return out


def anchor_rows(rows: DataFrame, hot: list[int], length: int = LENGTH) -> DataFrame:
    """Every anchor occurrence: key the anchor's hash, value its context's digest, size the bytes of the context left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(sorted(hot), np.int64)
        for b in slices(batches):
            doc, at, anchor, digests = [], [], [], []
            for i, data in enumerate(b.column(2)):
                data = data.as_py()
                places, hashes = anchors(data, length)
                doc.append(np.full(len(places), i))
                at.append(places)
                anchor.append(hashes)
                for p in places.tolist():
                    left = min(p, length - GRAM)
                    digests.append(xxhash.xxh3_64_intdigest(data[p - left:p + length], left))
            if digests:
                at = np.concatenate(at)
                yield from row_batches(b, np.concatenate(doc), np.concatenate(anchor).view(np.int64), np.array(digests, np.uint64).view(np.int64), at, np.minimum(at, length - GRAM), frequent)

    return rows.mapInArrow(run, ROW)


# -- suffix arrays ---------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement; at most 2 ** INDEX_BITS bytes."""
    n, bits = len(data), np.uint64(INDEX_BITS)
    low = np.uint64((1 << INDEX_BITS) - 1)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(5, np.uint64)])  # bytes are 1 to 256, the end is 0
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = key * np.uint64(257) + padded[k:n + k]
    packed = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    sa, key = (packed & low).astype(np.int64), packed >> bits
    # ranks by place; the end has rank 0
    rank, slots, depth = np.zeros(n + 1, np.int32), np.arange(n), 5
    new = np.concatenate([[True], key[1:] != key[:-1]])
    while True:
        # the rank of a group is its first slot, from 1; groups of one are sorted
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(slots)))
        rank[sa[slots]] = np.repeat(slots[starts], sizes) + 1
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return sa, rank[:n] - 1
        at = sa[slots]
        second = rank.take(at + depth, mode="clip").astype(np.uint64)  # past the end: the end
        packed = np.sort((rank[at].astype(np.uint64) << np.uint64(2 * INDEX_BITS + 1)) | (second << bits) | at.astype(np.uint64))
        sa[slots] = (packed & low).astype(np.int64)
        pair = packed >> bits
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        depth *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int, stride: int = 16) -> np.ndarray:
    """For every slot the bytes, up to ``cap``, that its suffix shares with the one before.

    Kasai's rule: the suffix one place further shares at least one byte less.
    It is applied to all places of equal remainder by ``stride`` at a time; eight bytes are compared at once.
    """
    n = len(data)
    before = np.empty(n, np.int32)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    padded = np.concatenate([data, np.zeros(cap + 8, np.uint8)])
    words = np.zeros(n + cap, np.uint64)  # the eight bytes from every place, the first one lowest
    for k in range(8):
        words |= padded[k:n + cap + k].astype(np.uint64) << np.uint64(8 * k)
    shared, known = np.zeros(n, np.int32), np.zeros(0, np.int32)
    for r in range(min(stride, n)):
        at = np.arange(r, n, stride)
        other = before[at]
        # a suffix ends where the data do, so its length bounds what it shares
        most = np.minimum(cap, n - np.maximum(at, other)).astype(np.int32)
        most[other < 0] = 0
        got = np.minimum(np.maximum(known[:len(at)] - 1, 0), most) if r else np.zeros(len(at), np.int32)
        todo = np.flatnonzero(got < most)
        while len(todo):
            have = got[todo]
            differ = words.take(at[todo] + have, mode="clip") ^ words.take(other[todo] + have, mode="clip")
            same = differ == 0
            lowest = differ & (~differ + np.uint64(1))
            more = np.where(same, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3).astype(np.int32)
            got[todo] = np.minimum(have + more, most[todo])
            todo = todo[same]
            todo = todo[got[todo] < most[todo]]
        shared[at] = known = got
    return shared[sa]


def equal_strings(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the ``length``-byte strings of the contexts: (class, context, place), grouped by class."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes)
    inside = np.arange(len(data)) <= np.repeat(ends, sizes) - length
    sa, _ = suffix_array(data)
    shared = common_prefixes(data, sa, length)
    slots = np.flatnonzero(inside[sa])
    if not len(slots):
        return (np.empty(0, np.int64),) * 3
    # strings at two slots differ if any neighbours from one to the other share less than ``length`` bytes
    cuts = np.cumsum(shared < length)[slots]
    at, new = sa[slots], np.concatenate([[True], cuts[1:] != cuts[:-1]])
    who = owner[at].astype(np.int64)
    return np.cumsum(new) - 1, who, at - (ends - sizes)[who]


#: A document in pandas: an id of 0 and the mark ``nameless`` for a null id, beside which pandas would round others.
DOC = ["doc_id", "nameless", "tag"]


def held_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({"nameless": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})


def true_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def _orders(part: pd.DataFrame) -> np.ndarray:
    """Rank of each row's document by (doc_id, tag), null ids first."""
    value, nameless, tag = (part[c].to_numpy() for c in DOC)
    order = np.lexsort((tag, value, ~nameless))
    changed = np.concatenate([[True], (value[order][1:] != value[order][:-1]) | (tag[order][1:] != tag[order][:-1]) | (nameless[order][1:] != nameless[order][:-1])])
    out = np.empty(len(part), np.int64)
    out[order] = np.cumsum(changed) - 1
    return out


FOUND = "doc_id long, nameless boolean, tag long, start long, stop long, string binary"


def _shard(part: pd.DataFrame, length: int) -> Iterator[pd.DataFrame]:
    """One shard, in blocks of whole anchors: covered ranges; for wide anchors also each class's string and earliest start."""
    part = part.sort_values(["anchor", *DOC, "at"], ignore_index=True)
    part["order"] = _orders(part)
    size = part["data"].map(len).to_numpy()
    block, held, anchor = [], 0, part["anchor"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    for s, e in zip(starts, np.append(starts[1:], len(part)), strict=True):
        grown = int(size[s:e].sum())
        if block and held + grown > BLOCK:
            yield _block(part.iloc[block[0]:block[-1]], length)
            block, held = [], 0
        block, held = [block[0] if block else s, e], held + grown
    if block:
        yield _block(part.iloc[block[0]:block[-1]], length)


def _block(part: pd.DataFrame, length: int) -> pd.DataFrame:
    kind, ctx, place = equal_strings(part["data"].tolist(), length)
    if not len(kind):
        return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype({"doc_id": "int64", "nameless": bool, "tag": "int64", "start": "int64", "stop": "int64", "string": object})
    doc = part["order"].to_numpy()[ctx]
    start = (part["at"].to_numpy() - part["left"].to_numpy())[ctx] + place
    order = (doc << 32) | start
    firsts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    least = np.minimum.reduceat(order, firsts)
    later = np.flatnonzero(order != least[kind])
    out = [_ranges(part, ctx[later], doc[later], start[later], length)]
    wide = part["wide"].to_numpy()
    if wide.any():
        keep = np.flatnonzero((order == least[kind]) & wide[ctx])
        _, one = np.unique(kind[keep], return_index=True)
        keep = keep[one]
        data = part["data"].to_numpy()
        rows = part.iloc[ctx[keep]][DOC].reset_index(drop=True)
        strings = [data[c][p:p + length] for c, p in zip(ctx[keep], place[keep], strict=True)]
        out.append(rows.assign(start=start[keep], stop=start[keep] + length, string=strings))
    return pd.concat(out, ignore_index=True)


def _ranges(part: pd.DataFrame, ctx: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """Starts of covered strings -> covered ranges."""
    order = np.lexsort((start, doc))
    ctx, doc, start = ctx[order], doc[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)])[:len(doc)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[:len(first)] - 1
    rows = part.iloc[ctx[first]][DOC].reset_index(drop=True)
    return rows.assign(start=start[first], stop=start[last] + length, string=None)


def _merge_shards(part: pd.DataFrame) -> pd.DataFrame:
    """Strings of several shards: all but the earliest of equal ones are covered. The earliest is found by binary search."""
    part = part.assign(order=_orders(part))
    strings = np.array([bytes(s) for s in part["string"]], dtype=f"S{len(part['string'].iat[0])}")
    order = np.lexsort((part["start"].to_numpy(), part["order"].to_numpy()))
    order = order[np.argsort(strings[order], kind="stable")]
    merged, doc, start = strings[order], part["order"].to_numpy()[order], part["start"].to_numpy()[order]
    first = np.searchsorted(merged, strings)
    later = (doc[first] != part["order"].to_numpy()) | (start[first] != part["start"].to_numpy())
    return part.loc[later, [*DOC, "start", "stop"]]


# -- the job ---------------------------------------------------------------------------


def repeated_ranges(rows: DataFrame, length: int = LENGTH, shard_bytes: int = 3 << 19, wide: int = WIDE) -> DataFrame:
    """(doc_id, tag, start, stop): ranges whose union is what is to be removed."""
    ship(rows)
    hot = frequent_keys(rows, lambda docs, known: anchor_rows(docs, known, length))
    later, different = occurrences(anchor_rows(rows, hot, length), "anchors")
    covered = later.select("doc_id", "tag", (F.col("at") - F.col("size")).cast("long").alias("start"), (F.col("at") + length).cast("long").alias("stop"))
    open_rows = materialise(different.select(F.col("key").alias("anchor"), "doc_id", "tag", "at", F.col("values").alias("contexts")), "open-contexts")

    shards = max(1, math.ceil(open_rows.count() * (2 * length - GRAM) / shard_bytes))
    per_doc = open_rows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "at", "contexts")).alias("open"))
    same = F.col("p.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("p.tag") == F.col("r.tag"))
    fetched = rows.alias("r").join(per_doc.alias("p"), same).select("r.doc_id", "r.tag", "r.data", "p.open")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, found = [], []
            for i, (data, wanted) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                data = data.as_py()
                for w in wanted.as_py():
                    piece, left = context(data, w["at"], length)
                    crowded = w["contexts"] > wide
                    for anchor in longer_anchors(piece, left, length) if crowded else [w["anchor"]]:
                        doc.append(i)
                        found.append((anchor, w["at"], left, crowded, piece))
            for s in range(0, len(doc), 1 << 14):
                anchor, at, left, crowded, piece = zip(*found[s:s + (1 << 14)], strict=True)
                which = pa.array(doc[s:s + (1 << 14)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), *(pa.array(x, pa.int64()) for x in (anchor, at, left)), pa.array(crowded), pa.array(piece, pa.binary())], names=["doc_id", "tag", "anchor", "at", "left", "crowded", "data"])

    contexts = materialise(fetched.mapInArrow(fetch, "doc_id long, tag long, anchor long, at long, left long, crowded boolean, data binary"), "contexts")
    crowds = contexts.where("crowded").groupBy("anchor").count().where("count > 1")
    crowded = contexts.where("crowded").join(crowds, "anchor").withColumn("wide", F.col("count") > wide)
    salt = F.when(F.col("wide"), 1 + F.pmod(F.xxhash64("doc_id", "tag", "at"), F.ceil(F.col("count") / wide))).otherwise(F.lit(0))
    crowded = crowded.withColumn("shard", F.when(F.col("wide"), F.xxhash64("anchor", salt)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))).drop("count")
    contexts = contexts.where("not crowded").withColumn("wide", F.lit(False)).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).unionByName(crowded).drop("crowded")

    found = held_ids(contexts).groupBy("shard").applyInPandas(lambda part: pd.concat(_shard(part, length), ignore_index=True), FOUND)
    found = materialise(found, "suffix-ranges")
    covered = covered.unionByName(true_ids(found.where("string is null").drop("string")))
    strings = found.where("string is not null").withColumn("bucket", F.pmod(F.xxhash64("string"), F.lit(shards * 8)))
    across = strings.groupBy("bucket").applyInPandas(_merge_shards, "doc_id long, nameless boolean, tag long, start long, stop long")
    return covered.unionByName(true_ids(across))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, ranges, kept (the remaining bytes)."""
    rows = document_rows(docs, id_col, text_col)
    return without_ranges(rows, merged_ranges(repeated_ranges(rows, length)), id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with their repeated ranges cut from the text, all columns kept."""
    return cut_texts(docs, merged_ranges(repeated_ranges(document_rows(docs, id_col, text_col), length)), id_col, text_col)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
