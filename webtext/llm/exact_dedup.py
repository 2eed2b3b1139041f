"""Exact dedup with a cuckoo-filter index over live text digests.

Every text is reduced to its SHA-256 digest in the JVM. Digests are counted
per (digest, salt), so a text that makes up a third of all rows reaches its
shard as at most ``SALTS`` rows. A shard holds a cuckoo filter (buckets of
four 16-bit fingerprints) and, in the same buckets, references to the stored
keys: a fingerprint hit counts only if the stored 32-byte digest agrees. An
insertion that finds no place within ``MAX_KICKS`` moves doubles the filter
and places all stored keys again. Digests can be inserted into and deleted
from an existing index (``update_index``).

Defined results: a null text counts as empty; of equal texts the row with the
largest id stays (null ids are smaller than all others; of rows that share
the largest id, one stays); an empty table gives no rows. Texts of any length
are hashed whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm.common import keep_rows, materialise, ship, table

SLOTS, MAX_KICKS, SALTS = 4, 500, 16

#: keep_ids holds 0 for a null id, which nameless marks: pandas would round ids beside a null.
INDEX_SCHEMA = "shard long, n_shards long, fingerprints binary, owners binary, keys binary, keep_rows array<long>, keep_ids array<long>, nameless array<boolean>, counts array<long>"


class CuckooIndex:
    """Cuckoo filter over stored 32-byte keys, held as an (n, 4) array of uint64 words."""

    def __init__(self, keys: np.ndarray | None = None, fingerprints: np.ndarray | None = None, owners: np.ndarray | None = None):
        self.keys = np.empty((0, 4), np.uint64) if keys is None else keys
        self.fingerprints = np.zeros((16, SLOTS), np.uint16) if fingerprints is None else fingerprints
        self.owners = np.full(self.fingerprints.shape, -1, np.int32) if owners is None else owners

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.fingerprints) - 1)
        fp = (keys[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        one = keys[:, 1] & mask
        return fp, one.astype(np.int64), self._other(one, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.fingerprints) - 1)
        return ((bucket.astype(np.uint64) ^ (fp.astype(np.uint64) * np.uint64(0x5BD1E995))) & mask).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key among the stored keys, -1 if absent; fingerprint hits are verified."""
        fp, one, two = self._places(keys)
        found = np.full(len(keys), -1, np.int64)
        for bucket in (one, two):
            for s in range(SLOTS):
                hit = np.flatnonzero((self.fingerprints[bucket, s] == fp) & (found < 0))
                owner = self.owners[bucket[hit], s]
                same = (self.keys[owner] == keys[hit]).all(axis=1)
                found[hit[same]] = owner[same]
        return found

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Insert keys (repeats allowed); position of each among the stored keys."""
        found = self.lookup(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            _, first = np.unique(np.ascontiguousarray(keys[missing]).view("S32").ravel(), return_index=True)
            new = keys[missing[np.sort(first)]]
            start = len(self.keys)
            self.keys = np.concatenate([self.keys, new])
            if len(self.keys) > 0.9 * self.fingerprints.size or not self._place(np.arange(start, len(self.keys))):
                self._resize()
            found[missing] = self.lookup(keys[missing])
        return found

    def _place(self, rows: np.ndarray) -> bool:
        fp, *buckets = self._places(self.keys[rows])
        for side in range(2):
            for s in range(SLOTS):
                bucket = buckets[side]
                free = np.flatnonzero(self.owners[bucket, s] < 0)
                _, first = np.unique(bucket[free], return_index=True)
                put = free[first]
                self.fingerprints[bucket[put], s], self.owners[bucket[put], s] = fp[put], rows[put]
                left = np.ones(len(rows), bool)
                left[put] = False
                rows, fp, buckets = rows[left], fp[left], [b[left] for b in buckets]
        return all(self._kick(int(r), int(f), int(b)) for r, f, b in zip(rows, fp, buckets[0], strict=True))

    def _kick(self, row: int, fp: int, bucket: int) -> bool:
        for k in range(MAX_KICKS):
            free = np.flatnonzero(self.owners[bucket] < 0)
            s = int(free[0]) if len(free) else (k * 7 + bucket) % SLOTS
            out_row, out_fp = int(self.owners[bucket, s]), int(self.fingerprints[bucket, s])
            self.owners[bucket, s], self.fingerprints[bucket, s] = row, fp
            if out_row < 0:
                return True
            row, fp = out_row, out_fp
            bucket = int(self._other(np.array([bucket]), np.array([fp], np.uint16))[0])
        return False

    def _resize(self) -> None:
        """Overflow: place every stored key in a table of at least twice the size."""
        while True:
            self.fingerprints = np.zeros((2 * len(self.fingerprints), SLOTS), np.uint16)
            self.owners = np.full(self.fingerprints.shape, -1, np.int32)
            if len(self.keys) <= 0.9 * self.fingerprints.size and self._place(np.arange(len(self.keys))):
                return

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Remove stored keys; the mask of those that remain."""
        gone = np.unique(self.lookup(keys))
        live = np.ones(len(self.keys), bool)
        live[gone[gone >= 0]] = False
        dead = (self.owners >= 0) & ~live[np.maximum(self.owners, 0)] if len(live) else np.zeros(self.owners.shape, bool)
        self.fingerprints[dead], self.owners[dead] = 0, -1
        renumber = np.cumsum(live) - 1
        self.owners = np.where(self.owners >= 0, renumber[np.maximum(self.owners, 0)] if len(live) else 0, -1).astype(np.int32)
        self.keys = self.keys[live]
        return live


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, digest) of every document, written to the shared folder; ``row`` numbers the rows."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")), "digests")


def _salted(digests: DataFrame) -> DataFrame:
    """Pre-aggregated rows (digest, n, keep_row, keep_id, nameless); at most SALTS for a digest."""
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    named = F.struct(F.col("id").isNotNull().alias("named"), F.coalesce("id", F.lit(0)).alias("id"), F.col("row").alias("row"))
    best = digests.groupBy("digest", salt.alias("salt")).agg(F.count("*").alias("n"), F.max(named).alias("best"))
    return best.select("digest", "n", F.col("best.row").alias("keep_row"), F.col("best.id").alias("keep_id"), (~F.col("best.named")).alias("nameless"))


def _sharded(batch: DataFrame, n_shards: int) -> DataFrame:
    return batch.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)))


Shard = tuple[CuckooIndex, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _load(state: pd.DataFrame) -> Shard:
    """(index, keep_rows, keep_ids, nameless, counts) of a shard."""
    if not len(state):
        return CuckooIndex(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    r = state.iloc[0]
    index = CuckooIndex(np.frombuffer(r["keys"], np.uint64).reshape(-1, 4), np.frombuffer(r["fingerprints"], np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(r["owners"], np.int32).reshape(-1, SLOTS).copy())
    return index, np.array(r["keep_rows"], np.int64), np.array(r["keep_ids"], np.int64), np.array(r["nameless"], bool), np.array(r["counts"], np.int64)


def _store(shard: int, n_shards: int, index: CuckooIndex, rows: np.ndarray, ids: np.ndarray, nameless: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({
        "shard": [shard], "n_shards": [n_shards], "fingerprints": [index.fingerprints.tobytes()], "owners": [index.owners.tobytes()], "keys": [np.ascontiguousarray(index.keys).tobytes()],
        "keep_rows": [rows], "keep_ids": [ids], "nameless": [nameless], "counts": [counts],
    })


def _inserted(state: pd.DataFrame, batch: pd.DataFrame, shard: int, n_shards: int) -> pd.DataFrame:
    index, rows, ids, nameless, counts = _load(state)
    if len(batch):
        at = index.insert(_words(batch["digest"]))
        grown = len(index.keys) - len(rows)
        rows, ids, nameless, counts = (np.concatenate([x, np.full(grown, fill, x.dtype)]) for x, fill in ((rows, -1), (ids, 0), (nameless, True), (counts, 0)))
        np.add.at(counts, at, batch["n"].to_numpy(np.int64))
        # one keeper per key: the largest id among the stored one and the batch, a null id last
        new_rows, new_ids, new_nameless = (batch[c].to_numpy() for c in ("keep_row", "keep_id", "nameless"))
        for k in np.lexsort((new_ids, ~new_nameless, at)):
            i = at[k]
            if rows[i] < 0 or (not new_nameless[k] and (nameless[i] or new_ids[k] > ids[i])):
                rows[i], ids[i], nameless[i] = new_rows[k], new_ids[k], new_nameless[k]
    return _store(shard, n_shards, index, rows, ids, nameless, counts)


def _built(batch: DataFrame, n_keys: int, keys_per_shard: int) -> DataFrame:
    n_shards = max(1, math.ceil(n_keys / keys_per_shard))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _inserted(pd.DataFrame(), rows, key[0], n_shards)

    return materialise(_sharded(batch, n_shards).groupBy("shard").applyInPandas(build, INDEX_SCHEMA), "cuckoo-index")


def build_index(digests: DataFrame, keys_per_shard: int = 32768) -> DataFrame:
    """The index of all digests, one row per shard, written to the shared folder.

    The row count bounds the number of keys, so a shard holds about
    ``keys_per_shard`` keys at any input size.
    """
    ship(digests)
    return _built(_salted(digests), digests.count(), keys_per_shard)


def update_index(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, keys_per_shard: int = 32768) -> DataFrame:
    """Insert digests (row, id, digest) into an index, or delete digests (digest) from it.

    An insertion that could double the keys of a shard deals all live keys anew to more shards.
    """
    ship(index)
    state = index.agg(F.max("n_shards"), F.sum(F.size("counts"))).first()
    n_shards, n_keys = state[0] or 1, state[1] or 0
    inserting = inserted is not None
    batch = _salted(inserted) if inserting else deleted.select("digest").distinct()
    if inserting and n_keys + inserted.count() > 2 * keys_per_shard * n_shards:
        live = live_digests(index).select("digest", F.col("group_size").alias("n"), "keep_row", F.coalesce("keep_id", F.lit(0)).alias("keep_id"), F.col("keep_id").isNull().alias("nameless"))
        return _built(live.unionByName(batch), n_keys + inserted.count(), keys_per_shard)

    def update(key: tuple, state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if inserting:
            return _inserted(state, rows, key[0], n_shards)
        held, *stored = _load(state)
        if len(rows):
            live = held.delete(_words(rows["digest"]))
            stored = [x[live] for x in stored]
        return _store(key[0], n_shards, held, *stored)

    return materialise(index.groupBy("shard").cogroup(_sharded(batch, n_shards).groupBy("shard")).applyInPandas(update, INDEX_SCHEMA), "cuckoo-index")


def live_digests(index: DataFrame) -> DataFrame:
    """(digest, keep_row, keep_id, group_size) of every live digest of an index."""
    ship(index)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                keys = r.keys
                yield pd.DataFrame({
                    "digest": [keys[i:i + 32] for i in range(0, len(keys), 32)], "keep_row": np.array(r.keep_rows, np.int64), "group_size": np.array(r.counts, np.int64),
                    "keep_id": np.array(r.keep_ids, np.int64), "nameless": np.array(r.nameless, bool),
                })

    live = index.select("keys", "keep_rows", "keep_ids", "nameless", "counts").mapInPandas(rows, "digest binary, keep_row long, group_size long, keep_id long, nameless boolean")
    return live.select("digest", "keep_row", F.when(~F.col("nameless"), F.col("keep_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    digests = digests_of(docs, id_col, text_col)
    groups = live_digests(build_index(digests))
    return digests.join(groups, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    decided = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("digest"))
    return keep_rows(docs, decided, id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
