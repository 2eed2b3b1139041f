"""As-of join: every left row gets the latest right row of its key at or before its own time.

Both sides are united and sorted by (key, time) in ranges, so a key that
holds a third of all rows lies in many ranges. Inside a range a running last
value finds the match; a row before the first right row of its key in the range takes the
last one of the ranges before it, which are handed on as one row per
key and range. No window spans a whole key, and each side's rows are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table


def _all(df: DataFrame, columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    columns: list[str],
    tie: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """All rows of ``left`` with ``columns`` of the matching ``right`` row, NULL where there is none.

    Of right rows with equal key and time the one with the largest ``tie`` matches.
    Rows with a NULL key or time match nothing. ``columns`` must not be named like
    left columns. Only ``on``, the times, ``tie`` and ``columns`` of the right side are
    read; callers keep wide columns out and fetch them by key afterwards.
    """
    known_left = F.col(f"`{left_time}`").isNotNull()
    known_right = F.col(f"`{right_time}`").isNotNull()
    for c in on:
        known_left, known_right = known_left & F.col(f"`{c}`").isNotNull(), known_right & F.col(f"`{c}`").isNotNull()
    keys = [f"_k{i}" for i in range(len(on))]
    match_type = right.select(_all(right, columns)).schema[0].dataType
    row_type = left.select(_all(left, left.columns)).schema[0].dataType
    tie_col = F.col(f"`{tie}`") if tie else F.lit(0)
    stored = right.where(known_right).select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)], F.col(f"`{right_time}`").alias("_time"), F.lit(0).alias("_side"), tie_col.alias("_tie"),
        _all(right, columns).alias("_match"), F.lit(None).cast(row_type).alias("_row"))
    asked = left.where(known_left).select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)], F.col(f"`{left_time}`").alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(stored.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(match_type).alias("_match"), _all(left, left.columns).alias("_row"))
    order = ["_time", "_side", "_tie"]
    both = stored.unionByName(asked)
    # the hash parts rows of one key and time; it is no part of the order inside a range
    cuts = [*keys, *order, F.xxhash64("_row")]
    spread = both.repartitionByRange(ranges, *cuts) if ranges else both.repartitionByRange(*cuts)
    swept = written_table(spread.withColumn("_range", F.spark_partition_id()), "asof")

    # the last match of every key in every range, handed on to the key's later ranges
    latest = F.max_by("_match", F.when(F.col("_side") == 0, F.struct("_time", "_tie")))
    pieces = swept.groupBy("_range", *keys).agg(latest.alias("_latest"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("_range", *keys, F.last("_latest", ignorenulls=True).over(before).alias("_carried"))

    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = swept.withColumn("_own", F.last("_match", ignorenulls=True).over(inside)).where("_side = 1")
    found = found.join(carried, ["_range", *keys], "left").select("_row.*", F.coalesce("_own", "_carried").alias("_match"))
    matched = found.select(*left.columns, *[F.col("_match")[c].alias(c) for c in columns])
    lost = left.where(~F.coalesce(known_left, F.lit(False))).select("*", *[F.lit(None).cast(match_type[c].dataType).alias(c) for c in columns])
    return matched.unionByName(lost)
