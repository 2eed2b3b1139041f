"""Keyed lookup in a wide table: a Bloom filter of the wanted keys is tested in the scan.

A shuffled join would exchange the wide columns of every row of the
table. The filter, an array of 64-bit words built by Spark from the wanted keys,
is a scalar of the plan, so rows that are not wanted end at the scan, but
for a few false positives, which the join drops.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 16, 6  # about 1 false positive in 1,000 others
MOST_BITS = 1 << 28  # 32 MB; more keys only mean more false positives


def _places(columns: list[Column], bits: int) -> list[Column]:
    """``HASHES`` bit numbers of a key, by double hashing below 2^40 (no overflow)."""
    low = F.lit((1 << 36) - 1)
    one = F.xxhash64(*columns).bitwiseAND(low)
    two = F.xxhash64(F.lit(1), *columns).bitwiseAND(low)
    return [(one + two * i).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def bloom_words(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """One row: the filter of all keys as an array of ``bits / 64`` longs. Bits are combined per word before the shuffle."""
    places = keys.select(F.explode(F.array(*_places([F.col(c) for c in columns], bits))).alias("place"))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = places.groupBy(F.shiftright("place", 6).alias("id")).agg(F.bit_or(one).alias("word"))
    whole = keys.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda s: s["word"]).alias("words"))


def might_hold(words: Column, columns: list[Column], bits: int) -> Column:
    hit = F.lit(True)
    for p in _places(columns, bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
        hit = hit & (word.bitwiseAND(mask) != 0)
    return hit


def wanted_rows(table: DataFrame, keys: DataFrame, columns: list[str], n_keys: int | None = None) -> DataFrame:
    """Rows of ``table`` that pass the filter of the wanted ``keys``: all whose key is wanted, few others.

    NULL keys are not wanted (as in a join). ``n_keys`` sizes the filter; counted if not given.
    """
    n = keys.count() if n_keys is None else n_keys
    bits = min(MOST_BITS, 1 << max(10, math.ceil(math.log2(max(n, 1) * BITS_PER_KEY))))
    words = bloom_words(keys.select(*columns), columns, bits).scalar()
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return table.where(known & might_hold(words, [F.col(c) for c in columns], bits))
