"""Conversation prefix trie, with subtree sums by centroid decomposition of the parent-edge forest.

Turns are reduced to a digest and a word count in the JVM and sorted in ranges, so that a
conversation that holds a third of all turns is numbered by many tasks. The id of a prefix is the
exclusive or of 64-bit hash pairs of its (position, turn digest), summed in blocks of ``BLOCK``
positions. Prefixes with equal ids are one node, named by (smallest member, depth): the
prefix of that member names every ancestor too.

The size of a node's subtree follows from its members alone: every node lies on the path of
its smallest member, so the subtree holds the own nodes of all other members and the rest of the smallest
member's path. Sizes give a component's centroid, the deepest node with more
than half of it below. Taking it out leaves its children's subtrees and the part above as components; the
total below is added along the path from the centroid up to the component's top, and the path's
sizes shrink. Components of more than ``LARGE`` nodes are split by Spark, one round for
all of them, of which a component gets half as large at least; smaller ones are dealt to tasks
in bins and split there in the same way, until no node is left.

Defined results: turns are ordered by turn (null first), ties by the digest of (role, text);
null role and text are empty; repeated rows are turns of their own; rows without a
conversation id take no part; an empty table has no conversation and no root, so it gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtext.llm.common import materialise, ship, table

BLOCK, LARGE, IDS = 4096, 4096, 4096
NODE = ["conv_id", "depth"]
TOP = ["top_conv", "top_depth"]
VALUES = ["n_leaves", "saved_tokens"]


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``facts``: one for each key, and ``n``, the number of its rows.

    The keys of more than a thousandth of all rows, at most a thousand, are broadcast, so that no
    task gets all rows of a hot key.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = facts.where(F.col("n") > max(64, total // 1000))
    facts = facts.drop("n")
    return rows.join(F.broadcast(hot.drop("n")), keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(facts, keys))


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, rank, digest, words) of every turn; rank from 1. Written to the shared folder."""
    ship(rows)
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["conv", F.asc_nulls_first("turn"), "digest"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            n = len(conv)
            if not n:
                continue
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank = np.arange(n) - start + 1
            if not new[0]:
                rank[:int(np.argmax(new)) if new.any() else n] += seen
            last, seen = conv[-1], int(rank[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, task, np.int32)), pa.array(rank), b.column(1), b.column(2)], names=["conv", "task", "rank", "digest", "words"])

    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")
    placed = materialise(placed.mapInArrow(number, "conv long, task int, rank long, digest binary, words long"), "placed-turns")
    # a conversation has one row for every task that holds some of it
    pieces = placed.groupBy("conv", "task").agg(F.max("rank").alias("n"))
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return materialise(placed.join(pieces, ["conv", "task"]).select("conv", (F.col("rank") + F.col("before")).alias("rank"), "digest", "words"), "ordered-turns")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with every conversation's first turns taken from its family's first conversation.

    Conversation c takes h = crc32(c in decimal) % heads turns of c - c % family and leaves out its own first h.
    """
    base = (F.col("conv") - F.col("conv") % family).alias("base")
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", base, (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    known = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(known, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    firsts = turns.where((F.col("rank") < heads) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    head = convs.select("conv", "base", "h").join(firsts, "base").where("rank <= h").select("conv", F.col("rank").alias("pos"), "digest", "words")
    own = lookup(turns, convs.select("conv", "n", "h", "taken"), ["conv"]).where("rank > h").select("conv", (F.col("rank") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    return head.unionByName(own), convs.select("conv")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, pos, x, y, words): the id of every prefix, the empty one (pos 0) too."""
    hashed = turns.withColumns({"block": F.floor(F.col("pos") / BLOCK), "x": F.xxhash64("pos", "digest"), "y": F.xxhash64(F.lit(1), "digest", "pos")})
    xor = {c: F.bit_xor(c) for c in ("x", "y")}
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("conv", "block").agg(*[v.alias(c) for c, v in xor.items()])
    blocks = blocks.select("conv", "block", *[F.coalesce(v.over(before), F.lit(0)).alias(f"{c}0") for c, v in xor.items()])
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.join(blocks, ["conv", "block"]).select("conv", "pos", *[v.over(inside).bitwiseXOR(F.col(f"{c}0")).alias(c) for c, v in xor.items()], "words")
    zero = F.lit(0).cast("long")
    empty = convs.select("conv", zero.alias("pos"), zero.alias("x"), zero.alias("y"), zero.alias("words"))
    return materialise(summed.unionByName(empty), "prefixes")


def trie(turns: DataFrame, convs: DataFrame, large: int = LARGE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv, pos, digest, words), pos from 1 without gaps; ``convs``: all conversations.
    """
    ship(turns)
    rows = prefixes(turns, convs)
    first = materialise(rows.groupBy("pos", "x", "y").agg(F.min("conv").alias("node"), F.count("*").alias("n")), "first-members")
    paths = materialise(lookup(rows, first, ["pos", "x", "y"]).select("conv", "pos", "node", "words"), "paths")
    mine = F.col("conv") == F.col("node")
    lengths = materialise(paths.groupBy("conv").agg(F.max("pos").alias("length"), F.sum(mine.cast("long")).alias("own"), F.count("*").alias("n")), "path-lengths")

    member = lookup(paths, lengths, ["conv"])
    nodes = member.groupBy(F.col("node").alias("conv_id"), F.col("pos").alias("depth")).agg(
        F.count("*").alias("n_convs"), F.max("words").alias("words"), F.sum("own").alias("all_own"), F.max(F.when(mine, F.col("own"))).alias("own"), F.max(F.when(mine, F.col("length"))).alias("length"))
    parents = paths.select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = nodes.join(parents, NODE, "left")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").select(
        *NODE, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.expr("all_own - own + length - depth + 1").alias("size"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    nodes = materialise(nodes, "trie-nodes")

    ends = ends_digests(paths.join(lengths.select("conv", F.col("length").alias("pos")), ["conv", "pos"]).select(F.col("node").alias("conv_id"), F.col("pos").alias("depth"), "conv"))
    out = nodes.drop("size", *VALUES).join(subtree_sums(nodes, paths, large), NODE).join(ends, NODE, "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): digest of the ascending ids ``conv`` of every node.

    Ranges of ids are written out as text by many tasks; a node's digest runs over its texts as a stream.
    """
    ends = materialise(ends, "trie-ends")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv_id, depth, conv = (b.column(i).to_numpy() for i in range(3))
            if not len(conv):
                continue
            new = np.concatenate([[True], (conv_id[1:] != conv_id[:-1]) | (depth[1:] != depth[:-1])])
            new[::IDS] = True
            start = np.flatnonzero(new)
            texts = [",".join(map(str, x.tolist())) for x in np.split(conv, start[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(conv_id[start]), pa.array(depth[start]), pa.array(conv[start]), pa.array(texts, pa.string())], names=["conv_id", "depth", "first", "ids"])

    texts = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(join_ids, "conv_id long, depth long, first long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out: list[tuple] = []
            for conv_id, depth, ids in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if key == (conv_id, depth):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (conv_id, depth), hashlib.sha256(ids.encode())
            yield _digests(out)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["conv_id", "depth", "ends_sha256"])


def subtree_sums(nodes: DataFrame, paths: DataFrame, large: int = LARGE) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): sums over all subtrees of a tree of nodes.

    ``nodes``: conv_id, depth, parent_conv_id, size (nodes in the subtree) and the values;
    ``paths``: (conv, pos, node), the ancestor at depth pos of the nodes named by conv.
    """
    ship(nodes)
    zero = F.lit(0).cast("long")
    root = nodes.where("depth = 0").select("conv_id", "size").first()  # one row, or none
    n_nodes = root["size"] if root else 0
    left = nodes.withColumns({"top_conv": F.lit(root["conv_id"] if root else 0).cast("long"), "top_depth": zero})
    # adds: what centroids below have added so far
    left = left.select(*NODE, F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), "size", *VALUES, *TOP, *[zero.alias(f"add_{v}") for v in VALUES])
    done, ready = [], []
    while True:
        tops = left.where("conv_id = top_conv and depth = top_depth and size > " + str(large)).select(*TOP, F.col("size").alias("total"))
        if tops.isEmpty():
            ready.append(left)
            break
        # every large component has more than ``large`` nodes, which bounds the number of these rows
        tops = F.broadcast(tops)
        ready.append(left.join(tops, TOP, "left_anti"))
        big = left.join(tops, TOP)
        at = big.where("2 * size > total").groupBy(*TOP).agg(F.min_by(F.struct("conv_id", "depth", "size"), "size").alias("c"))
        centroids = materialise(at.select(*TOP, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")), "centroids")
        big = big.drop("total").join(F.broadcast(centroids), TOP).withColumn("block", F.floor(F.col("depth") / BLOCK))
        # nodes deeper than the centroid: their ancestors at its depth and below it
        asked = big.where("depth > c_depth and conv_id <> c_conv").select("conv_id", "block", *TOP, "c_conv", "c_depth").distinct()
        same = paths.select(F.col("conv").alias("conv_id"), F.col("pos").alias("c_depth"), F.col("node").alias("c_conv"))
        child = paths.select(F.col("conv").alias("conv_id"), (F.col("pos") - 1).alias("c_depth"), F.col("node").alias("child"))
        below = asked.join(same, ["conv_id", "c_depth", "c_conv"], "left_semi").join(child, ["conv_id", "c_depth"]).select("conv_id", "block", *TOP, "child")
        big = big.join(below, ["conv_id", "block", *TOP], "left")
        inside = F.col("depth") > F.col("c_depth")
        big = big.withColumn("child", F.when(inside & (F.col("conv_id") == F.col("c_conv")), F.col("c_conv")).when(inside, F.col("child")))
        big = big.withColumn("centre", (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth")))
        big = materialise(big.drop("block"), "split-components")
        totals = big.where("centre or child is not null").groupBy(*TOP).agg(*[F.sum(v).alias(f"t_{v}") for v in VALUES])
        centroids = materialise(centroids.join(totals, TOP), "centroid-totals")
        big = big.join(F.broadcast(centroids.drop("c_conv", "c_depth", "c_size")), TOP)
        done.append(big.where("centre").select(*NODE, *[(F.col(f"add_{v}") + F.col(f"t_{v}")).alias(v) for v in VALUES]))
        # the path from the centroid up to the top
        way = paths.join(F.broadcast(centroids.withColumnRenamed("c_conv", "conv").select("conv", "c_depth", "top_depth")), "conv").where("pos >= top_depth and pos < c_depth")
        way = way.select(F.col("node").alias("conv_id"), F.col("pos").alias("depth"), F.lit(True).alias("on_way")).distinct()
        rest = big.where("not centre").join(way, NODE, "left")
        # only the part above the centroid holds nodes of the way
        on = F.coalesce(F.col("on_way"), F.lit(False)) & F.col("child").isNull()
        left = materialise(rest.select(
            *NODE, "parent_conv_id", (F.col("size") - F.when(on, F.col("c_size")).otherwise(0)).alias("size"), *VALUES,
            F.coalesce("child", "top_conv").alias("top_conv"), F.when(F.col("child").isNull(), F.col("top_depth")).otherwise(F.col("c_depth") + 1).alias("top_depth"),
            *[(F.col(f"add_{v}") + F.when(on, F.col(f"t_{v}")).otherwise(0)).alias(f"add_{v}") for v in VALUES]), "components")

    small = ready[0]
    for part in ready[1:]:
        small = small.unionByName(part)
    bins = max(1, -(-n_nodes // large))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sums = rolled_up(part)
        return pd.DataFrame({c: part[c] for c in NODE} | {v: sums[:, i] + part[f"add_{v}"].to_numpy() for i, v in enumerate(VALUES)})

    out = small.withColumn("bin", F.pmod(F.xxhash64(*TOP), F.lit(bins))).groupBy("bin").applyInPandas(run, "conv_id long, depth long, n_leaves long, saved_tokens long")
    for part in done:
        out = out.unionByName(part)
    return out


def rolled_up(part: pd.DataFrame) -> np.ndarray:
    """Subtree sums of the values within whole components, by centroid decomposition."""
    part = part.reset_index(drop=True)
    n = len(part)
    place = {k: i for i, k in enumerate(zip(part["conv_id"], part["depth"], strict=True))}
    tops = list(zip(part["top_conv"], part["top_depth"], strict=True))
    top = np.array([place[k] for k in tops], np.int64)
    parent = np.array([-1 if top[i] == i else place[k] for i, k in enumerate(zip(part["parent_conv_id"], part["depth"] - 1, strict=True))], np.int64)
    span = part["size"].to_numpy(np.int64)
    enter, free = [0] * n, [0] * n  # numbers in depth-first order: a subtree is enter, ..., enter + span - 1
    start = 0
    for i in np.argsort(part["depth"].to_numpy(), kind="stable").tolist():
        p = parent[i]
        if p < 0:
            enter[i], start = start, start + int(span[i])
        else:
            enter[i], free[p] = free[p], free[p] + int(span[i])
        free[i] = enter[i] + 1
    enter, size = np.array(enter), span.copy()
    values = part[VALUES].to_numpy(np.int64)
    sums, centre = np.zeros_like(values), np.empty(n, np.int64)
    left = np.arange(n)
    while len(left):
        heavy = left[2 * size[left] > size[top[left]]]
        order = heavy[np.lexsort((size[heavy], top[heavy]))]
        first = np.concatenate([[True], top[order][1:] != top[order][:-1]])
        centre[top[order[first]]] = order[first]
        c = centre[top[left]]
        under = (enter[left] >= enter[c]) & (enter[left] < enter[c] + span[c])
        total = np.zeros_like(values)
        np.add.at(total, c[under], values[left[under]])
        over = (enter[left] <= enter[c]) & (enter[c] < enter[left] + span[left])  # the centroid and the way up
        sums[left[over]] += total[c[over]]
        above = over & (left != c)
        size[left[above]] -= size[c[above]]
        inside = left[under & (left != c)]
        if len(inside):
            inside = inside[np.lexsort((enter[inside], top[inside]))]
            opens = parent[inside] == centre[top[inside]]
            top[inside] = inside[np.maximum.accumulate(np.where(opens, np.arange(len(inside)), 0))]
        left = left[left != c]
    return sums


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, substr(sha256(concat(length(role), ':', role, text)), 1, 32)) AS turns,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
               lambda acc, s: list_reduce(list_prepend(xor(acc, s), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM t GROUP BY c
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM conv a LEFT JOIN conv b ON b.c = a.c - a.c % 20
), p AS (
  SELECT c, d, turns[1:d] AS key, len(turns) AS length FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)
), node AS (
  SELECT d, key, min(c) AS m, count(*) AS n,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(key[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM p GROUP BY d, key
), path AS (
  SELECT p.c, p.d, p.length, node.m FROM p JOIN node ON p.d = node.d AND p.key = node.key
), parent AS (
  SELECT node.m, node.d, node.n, node.words, path.m AS parent FROM node LEFT JOIN path ON path.c = node.m AND path.d = node.d - 1
), fan AS (
  SELECT parent AS m, d - 1 AS d, count(*) AS children FROM parent WHERE d > 0 GROUP BY ALL
), one AS (
  SELECT parent.*, coalesce(children, 0) AS children FROM parent LEFT JOIN fan USING (m, d)
), sums AS (
  SELECT path.m, path.d, count(*) FILTER (WHERE one.children = 0) AS leaves, sum((one.n - 1) * one.words) AS saved
  FROM one JOIN path ON path.c = one.m AND path.d <= one.d GROUP BY ALL
), ends AS (
  SELECT m, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest FROM path WHERE d = length GROUP BY ALL
)
SELECT one.m AS conv_id, one.d AS depth, one.parent AS parent_conv_id, one.n AS n_convs, CAST(one.children AS BIGINT) AS n_children,
       CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends.digest, sha256('')) AS ends_sha256
FROM one JOIN sums USING (m, d) LEFT JOIN ends USING (m, d)
"""
