"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are dealt to blocks. A block projects its vectors on ``PROJECTIONS``
fixed random lines (orthogonal in sets as large as the dimension, which
evens out the counts) and sorts every projection. A query opens a window centred
on its own projection in each sorted array; virtual rehashing widens all
windows by a constant factor, and a vector collides once per line whose window
holds it. Vectors that collide on at least ``THRESHOLD`` of the lines are
candidates; widening ends when a block has ``FRACTION`` of its vectors, and
``FLOOR`` * k, as candidates, or has all. Every candidate is verified with its exact inner
product in double precision. The largest inner product becomes the smallest
distance by one more coordinate that gives all vectors of a block equal length.

Equal rows count once. Of identical vectors only the k + 1 smallest ids can
appear in an answer, so the others are left out before the blocks are made:
exact, and a vector that makes up a third of the rows does not fill the blocks.
A query's own rows are not among its candidates. Queries and vectors meet in
blocks of fixed size; the answers of the blocks are merged by rank.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without an id, take no part; a query is compared with
vectors of its own length only; ties go to the smaller id; fewer than k
candidates are all returned; a repeated id counts as one row per distinct
vector; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtext.llm.common import materialise, ship, table

PROJECTIONS, THRESHOLD, WIDTH, GROWTH, SEED = 128, 0.64, 1.0, 1.06, 7
FRACTION, FLOOR = 0.05, 20  # a block verifies at least this share of its vectors, and at least FLOOR * k
HITS = "query_id long, vec_id long, score double"


class ProjectionBlock:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        norms = (vectors**2).sum(axis=1)
        self.reach = math.sqrt(norms.max())
        dim, rng = vectors.shape[1] + 1, np.random.default_rng(SEED)
        bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
        self.lines = np.concatenate(bases, axis=1)[:, :PROJECTIONS] * math.sqrt(dim)
        level = np.sqrt(np.maximum(self.reach**2 - norms, 0))
        projected = np.column_stack([vectors, level]) @ self.lines
        order = np.argsort(projected, axis=0).T
        self.sorted = np.take_along_axis(projected.T, order, axis=1)
        self.rank = np.empty(order.shape, np.uint16)  # place of each vector in each sorted array
        np.put_along_axis(self.rank, order, np.arange(len(vectors), dtype=np.uint16)[None, :], axis=1)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each vector the number of lines whose window, places low to high, holds it."""
        inside = (self.rank - low.astype(np.uint16)[:, None]) < (high - low).astype(np.uint16)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)

    def search(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Rows of the candidates of every query, which have other ids than the query's ``own``."""
        n = len(self.vectors)
        enough, least = max(FLOOR * k, math.ceil(FRACTION * n)), math.ceil(THRESHOLD * PROJECTIONS)
        order = np.sort(ids)
        need = np.minimum(enough, n - (np.searchsorted(order, own, "right") - np.searchsorted(order, own)))
        scaled = queries * (self.reach / np.sqrt((queries**2).sum(axis=1)))[:, None]
        centre = scaled @ self.lines[:-1]
        found: list = [None] * len(queries)
        active, width = np.arange(len(queries)), WIDTH * self.reach
        while len(active):
            low = np.stack([np.searchsorted(a, c - width) for a, c in zip(self.sorted, centre[active].T, strict=True)], axis=1)
            high = np.stack([np.searchsorted(a, c + width, "right") for a, c in zip(self.sorted, centre[active].T, strict=True)], axis=1)
            for i, q in enumerate(active):
                near = np.flatnonzero(self.collisions(low[i], high[i]) >= least)
                near = near[ids[near] != own[q]]
                if len(near) >= need[q]:
                    found[q] = near
            active = np.array([q for q in active if found[q] is None], np.int64)
            width *= GROWTH
        return found


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best verified candidates of each query in one block."""
    if not 0 < len(vectors) < 2**16 or not len(queries):
        assert len(vectors) < 2**16, "a block's places are 16-bit numbers"
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    ids, owns = vectors["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
    asked, data = _rows(queries["vec"]), _rows(vectors["vec"])
    block, out = ProjectionBlock(data), []
    for start in range(0, len(asked), 1024):
        part, own = asked[start:start + 1024], owns[start:start + 1024]
        for q, near in enumerate(block.search(part, k + 1, ids, own)):
            score = (data[near] * part[q]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": own[q], "vec_id": ids[near[best]], "score": score[best]}))
    return pd.concat(out)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, query_filter, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every vector whose id meets ``query_filter``."""
    ship(vectors)
    rows = usable(vectors, id_col, vec_col).distinct()
    same = Window.partitionBy("vec").orderBy("vec_id")
    kept = materialise(rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    asked = materialise(rows.where(query_filter(F.col("vec_id"))), "vector-queries")
    n_blocks, n_asked = (max(1, math.ceil(df.count() / n)) for df, n in ((kept, block_rows), (asked, query_rows)))

    def deal(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        dealt = df.withColumn("dim", F.size("vec")).withColumn(own, F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_own)))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).withColumn(other, F.col(other).cast("long"))

    a = deal(kept, "block", n_blocks, "ask", n_asked).groupBy("dim", "block", "ask")
    b = deal(asked, "ask", n_asked, "block", n_blocks).groupBy("dim", "block", "ask")
    hits = a.cogroup(b).applyInPandas(lambda v, q: search_block(v, q, k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0, 20)
