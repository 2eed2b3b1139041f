"""Difference of two crawl snapshots as bags of (url, content digest).

Both are united and counted once per (url, digest), combined map-side, so
a page that is stored a million times is one partial row per task. With n copies before and
m after, EXCEPT ALL gives m - n added or n - m removed copies and INTERSECT ALL the smaller number repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_difference(before: DataFrame, after: DataFrame, content_col: str = "html") -> DataFrame:
    """(url, digest, n_before, n_after, n_added, n_removed, n_repeated, change) of every stored (url, content).

    ``change``: ``changed`` where copies of the URL were added and others of it removed, else ``added``,
    ``removed`` or ``repeated``. NULL content has a NULL digest, equal to itself; NULL URLs are one URL.
    Contents are hashed in the scan; only (url, digest) is shuffled.
    """
    def bag(df: DataFrame, old: int) -> DataFrame:
        return df.select("url", F.sha2(content_col, 256).alias("digest"), F.lit(old).alias("b"), F.lit(1 - old).alias("a"))

    both = bag(before, 1).unionByName(bag(after, 0)).groupBy("url", "digest").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    zero = F.lit(0).cast("long")
    both = both.withColumns({
        "n_added": F.greatest(F.col("n_after") - F.col("n_before"), zero),
        "n_removed": F.greatest(F.col("n_before") - F.col("n_after"), zero),
        "n_repeated": F.least("n_before", "n_after"),
    })
    per_url = both.groupBy("url").agg((F.sum("n_added") > 0).alias("_added"), (F.sum("n_removed") > 0).alias("_removed"))
    joined = both.join(per_url.withColumnRenamed("url", "_url"), F.col("url").eqNullSafe(F.col("_url")))
    moved = (F.col("n_added") > 0) | (F.col("n_removed") > 0)
    change = F.when(moved & F.col("_added") & F.col("_removed"), "changed").when(F.col("n_added") > 0, "added").when(F.col("n_removed") > 0, "removed").otherwise("repeated")
    return joined.select("url", "digest", "n_before", "n_after", "n_added", "n_removed", "n_repeated", change.alias("change"))
