"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its ``NEAREST`` reference points (pivots) in order of nearness. Pivots
are a bounded sample of the vectors (``PER_ROOT`` times the square root of the largest label's
rows, at most ``MOST_PIVOTS``), without those that are near duplicates of others;
every vector is indexed. Inverted lists are kept for pairs of pivots: a vector is in
the lists of all pairs of its ``LISTED`` nearest pivots, so two vectors meet
if they share two of these, and the lists stay short as pivots grow with the rows. Vectors that
meet and share at least ``SHARED`` of all their described pivots are verified by
their exact cosine in double precision.

Groups of copies are condensed first. Vectors of one label and one nearest pivot are
read in chunks; a chunk's vectors within half the threshold's angle of a leader form a
class, and leaders of large classes are merged in further rounds. By the triangle
inequality all members of a class are links, whatever their number. Candidates
are pairs of classes: the leaders' angle and the classes' radii decide most of them whole,
the others are verified member by member in blocks, which keep counts and no pairs.

Defined results: every row is a vector of its own, repeated rows and ids too; vectors
that are null, zero, or hold null or non-finite components, and rows without a label, link
with nothing; only vectors of equal label and length are compared; a row without an id has no
say in its component's id, and a component of such rows alone has a null id and is kept;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm.common import materialise, ship, table
from webtext.llm.components import connected_components

NEAREST, LISTED, SHARED = 16, 8, 5
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 12, 32, 32767
CHUNK, DENSE, ROUNDS = 1024, 8, (2, 4, 8)
EPS = 1e-7  # radians; bounds this close to the threshold are verified


def units(vectors: pd.Series) -> np.ndarray:
    """Rows of unit length in double precision; scaled by their largest component first."""
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: DataFrame, least: float) -> dict[int, np.ndarray]:
    """Length -> pivots of that length: a sample by hash, at most 2 * MOST_PIVOTS rows, near duplicates left out."""
    largest = vectors.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(PER_ROOT * math.sqrt(largest))))
    sample = vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(2 * wanted).collect()
    out = {}
    for dim, rows in itertools.groupby(sorted((r[0] for r in sample), key=len), key=len):
        rows = units(pd.Series(list(rows)))
        kept, n = np.empty_like(rows), 0
        for row in rows:
            if n < wanted and not (n and (kept[:n] @ row).max() >= least):
                kept[n] = row
                n += 1
        out[dim] = kept[:n]
    return out


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of every row, nearest first."""
    n = min(NEAREST, len(pivots))
    score = rows @ pivots.T
    near = np.argpartition(-score, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, axis=1), axis=1, kind="stable"), axis=1)


def lead(rows: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For every row its leader and their cosine: rows in order, each takes all free rows within ``cosine`` of it."""
    leader, near = np.full(len(rows), -1), np.ones(len(rows))
    for i in range(len(rows)):
        if leader[i] < 0:
            score = rows[i:] @ rows[i]
            taken = np.flatnonzero((leader[i:] < 0) & (score >= cosine))
            leader[i + taken], near[i + taken] = i, score[taken]
            leader[i], near[i] = i, 1.0
    return leader, near


def _runs(parts: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Runs of sorted rows with equal keys, at most ``most`` rows long."""
    held: pd.DataFrame | None = None
    for part in itertools.chain(parts, [None]):
        if part is not None:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
        if held is None or not len(held):
            continue
        new = np.concatenate([[True], np.logical_or.reduce([held[k].to_numpy()[1:] != held[k].to_numpy()[:-1] for k in keys])])
        starts = np.append(np.flatnonzero(new), len(held))
        done = 0
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e == len(held) and part is not None and e - s < most:
                break  # the last run may go on
            for i in range(s, e, most):
                yield held.iloc[i:min(i + most, e)]
            done = e
        held = held.iloc[done:].reset_index(drop=True)


def _led(df: DataFrame, order: list[str], cosine: float, schema: str) -> DataFrame:
    """Rows (part, cell, row, vec, ...) with the leader of each in its chunk of one part and cell."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _runs(parts, ["part", "cell"], CHUNK):
            leader, near = lead(units(chunk["vec"]), cosine)
            yield chunk.assign(leader=chunk["row"].to_numpy()[leader], cosine=near)[names]

    # a hot cell lies in several ranges, as the hash of the row is part of the key
    return df.repartitionByRange("part", "cell", *order).sortWithinPartitions("part", "cell", *order).mapInPandas(run, schema)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def condense(vectors: DataFrame, pivots: dict[int, np.ndarray], least: float, vec_type: str) -> tuple[DataFrame, DataFrame]:
    """(led, members): rows with their vectors and chunk leaders; rows (row, vec_id, part, perm, leader, class, cosine) without vectors.

    ``class`` is the row number of a vector within half the threshold's angle of the row.
    """
    half = math.cos(math.acos(least) / 2 - EPS)

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = part["vec"].map(len).to_numpy()
            perms: list = [[]] * len(part)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                if dim in pivots:
                    for i, p in zip(at, nearest_pivots(units(part["vec"].iloc[at]), pivots[dim]), strict=True):
                        perms[i] = p.astype(np.int16)
            yield part.assign(perm=perms, cell=[int(p[0]) if len(p) else -1 for p in perms])

    # pandas would round ids beside a null one
    held = vectors.select("row", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("nameless"), "part", "vec")
    named = f"row long, vec_id long, nameless boolean, part string, vec {vec_type}, perm array<short>, cell int"
    led = materialise(_led(held.mapInPandas(describe, named).withColumn("h", F.xxhash64("row")), ["h", "row"], half, named + ", leader long, cosine double"), "led-vectors")
    led = led.withColumn("vec_id", F.when(~F.col("nameless"), F.col("vec_id"))).drop("nameless")

    # leaders of large classes join leaders that they find in coarser cells
    sizes = led.groupBy("leader").count()
    leads = led.where("row = leader").join(sizes.where(F.col("count") >= DENSE), "leader").select("row", "part", "vec", "perm", "count")
    moves = None
    for n in ROUNDS:
        found = materialise(_led(leads.withColumn("cell", F.array_min(F.slice("perm", 1, n)).cast("int")).withColumn("fewer", -F.col("count")), ["fewer", "row"], half, f"row long, part string, vec {vec_type}, perm array<short>, count long, leader long"), "class-leaders")
        step = found.select(F.col("row").alias("leader"), F.col("leader").alias("next"))
        moves = step if moves is None else moves.withColumnRenamed("next", "via").join(step.withColumnRenamed("leader", "via"), "via").select("leader", "next")
        grown = found.groupBy("leader").agg(F.sum("count").alias("count")).withColumnRenamed("leader", "row")
        leads = found.where("row = leader").drop("leader", "count").join(grown, "row").select("row", "part", "vec", "perm", "count")
    # a chunk's leader has at most CHUNK members, so no key of this join is hot
    target = led.where("row = leader").select(F.col("row").alias("next"), F.col("vec").alias("next_vec"))
    moved = led.select("row", "vec", "leader").join(moves.where("leader <> next").join(target, "next"), "leader")
    near = _dot("vec", "next_vec") / F.sqrt(_dot("vec", "vec") * _dot("next_vec", "next_vec"))
    moved = moved.select("row", F.col("next").alias("class"), near.alias("near")).where(F.col("near") >= half)
    members = led.drop("vec", "cell").join(moved, "row", "left").withColumn("class", F.coalesce("class", "leader")).withColumn("cosine", F.coalesce("near", "cosine")).drop("near")
    return led, materialise(members, "class-members")


def candidates(members: DataFrame, longest: int = 512, listed: int = LISTED, shared: int = SHARED) -> DataFrame:
    """(a, b), a < b: classes with members that share two of their ``listed`` and ``shared`` of all their described pivots.

    Lists of more than ``longest`` entries are split into parts that meet in pairs.
    """
    pair = "transform(sequence(0, size(top) - 2), i -> transform(sequence(i + 1, size(top) - 1), j -> xxhash64(part, least(top[i], top[j]), greatest(top[i], top[j]))))"
    lone = "array(xxhash64(part, top[0]))"
    described = members.select("class", "part", F.sort_array("perm").alias("perm"), F.slice("perm", 1, listed).alias("top")).where("size(top) > 0")
    entries = described.select(F.explode(F.expr(f"if(size(top) > 1, flatten({pair}), {lone})")).alias("list"), "class", "perm").distinct()
    long_ = entries.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > longest)
    split = entries.join(long_, "list", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / longest), F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64("class", "perm"), F.col("parts")).cast("int"))
    met = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # side 0: all pairs of the part; 1 and 2: pairs between two parts
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    met = met.select(F.when(F.col("parts") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))).alias("list"), side.alias("side"), "class", "perm")

    def pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in itertools.chain(parts, [None]):
            if part is not None:
                held = part if held is None else pd.concat([held, part], ignore_index=True)
            if held is None or not len(held):
                continue
            whole = held
            if part is not None:  # the last list may go on
                last = int(np.searchsorted(held["list"].to_numpy(), held["list"].iloc[-1]))
                whole, held = held.iloc[:last], held.iloc[last:].reset_index(drop=True)
            found = _sharing(whole, shared)
            if len(found):
                yield found

    ordered = met.repartition("list").sortWithinPartitions("list", "class")
    return ordered.mapInPandas(pairs, "a long, b long").distinct()


def _sharing(entries: pd.DataFrame, least: int) -> pd.DataFrame:
    """Class pairs of whole lists (list, side, class, perm), sorted by list and class, whose entries share enough pivots."""
    out = []
    lists, classes = entries["list"].to_numpy(), entries["class"].to_numpy()
    if len(lists):
        start = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        end = np.append(start[1:], len(lists)) - 1
        several = np.repeat(classes[start] != classes[end], end - start + 1)
        entries = entries[several]
        lists, classes = lists[several], classes[several]
    side, sizes = entries["side"].to_numpy(), entries["perm"].map(len).to_numpy()
    perm = np.full((len(entries), NEAREST), -1, np.int16)
    for i, p in enumerate(entries["perm"]):
        perm[i, :len(p)] = p
    lag, at = 1, np.arange(max(0, len(lists) - 1))
    while len(at):
        at = at[at + lag < len(lists)]
        at = at[lists[at] == lists[at + lag]]
        i = at[(classes[at] != classes[at + lag]) & ((side[at] == 0) | (side[at] != side[at + lag]))]
        for s in range(0, len(i), 1 << 14):
            x = i[s:s + (1 << 14)]
            y = x + lag
            common = ((perm[x][:, :, None] == perm[y][:, None, :]) & (perm[x] >= 0)[:, :, None]).sum(axis=(1, 2))
            good = common >= np.minimum(least, np.minimum(sizes[x], sizes[y]))
            out.append(pd.DataFrame({"a": classes[x[good]], "b": classes[y[good]]}))
        lag += 1
    found = pd.concat(out) if out else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    return pd.DataFrame({"a": np.minimum(found["a"], found["b"]), "b": np.maximum(found["a"], found["b"])}).drop_duplicates()


def judge(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, n_a, n_b, all): class pairs that link wholly (all) or may link in part."""
    far = math.acos(least)
    sides = [classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("part", "vec", "n", "radius")], F.col("class").alias(s)) for s in "ab"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[(p["part_a"] == p["part_b"]).to_numpy()].reset_index(drop=True)
            if not len(p):
                continue
            dot = np.concatenate([(units(x["vec_a"]) * units(x["vec_b"])).sum(axis=1) for _, x in p.groupby(p["vec_a"].map(len), sort=False)])
            p = pd.concat([x for _, x in p.groupby(p["vec_a"].map(len), sort=False)], ignore_index=True)
            angle, reach = np.arccos(np.clip(dot, -1, 1)), (p["radius_a"] + p["radius_b"]).to_numpy()
            single = (p["n_a"] == 1).to_numpy() & (p["n_b"] == 1).to_numpy()
            p["all"] = np.where(single, dot >= least, angle + reach <= far - EPS)
            maybe = np.where(single, p["all"], angle - reach <= far + EPS)
            yield p.loc[maybe, ["a", "b", "n_a", "n_b", "all"]]

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInPandas(run, "a long, b long, n_a long, n_b long, all boolean")


def member_links(partly: DataFrame, members: DataFrame, led: DataFrame, least: float, piece: int = 512) -> DataFrame:
    """(row, n, a, b): members with links across class pairs that link in part, verified in blocks of two pieces."""
    pieces = [F.ceil(F.col(f"n_{s}") / piece).cast("int") for s in "ab"]
    asked = partly.select("a", "b", pieces[0].alias("k"), pieces[1].alias("m"))
    blocks = asked.withColumn("i", F.explode(F.expr("sequence(0, k - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, m - 1)")))
    sizes = asked.select(F.col("a").alias("class"), F.col("k").alias("pieces")).union(asked.select("b", "m")).distinct()
    keyed = members.select("row", "class", "leader").join(sizes, "class")
    rows = led.select("row", "vec").join(keyed.select("row", "class", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece")), "row")
    left = blocks.join(rows.withColumnsRenamed({"class": "a", "piece": "i"}), ["a", "i"])
    right = blocks.join(rows.withColumnsRenamed({"class": "b", "piece": "j"}), ["b", "j"])

    def cross(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("row", "n", "a", "b")})
        near = units(x["vec"]) @ units(y["vec_r"]).T >= least
        out = pd.DataFrame({"row": np.concatenate([x["row"], y["row_r"]]), "n": np.concatenate([near.sum(axis=1), near.sum(axis=0)]), "a": x["a"].iloc[0], "b": x["b"].iloc[0]})
        return out[out["n"] > 0]

    key = ["a", "b", "i", "j"]
    right = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    return left.groupBy(*key).cogroup(right.groupBy(*[f"{c}_r" for c in key])).applyInPandas(cross, "row long, n long, a long, b long")


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", listed: int = LISTED, shared: int = SHARED) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    ship(vectors)
    kind = vectors.select(vec_col).schema[0].dataType.simpleString()
    vec_type = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast(vec_type).alias("vec"))
    good = usable(F.col("vec")) & F.col("label").isNotNull()
    part = F.concat(F.size("vec").cast("string"), F.lit(":"), F.col("label").cast("string"))
    joined = rows.where(good).select("row", "vec_id", part.alias("part"), "vec")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    led, members = condense(joined, choose_pivots(joined, least), least, vec_type)
    classes = members.groupBy("class").agg(F.first("part").alias("part"), F.count("*").alias("n"), F.min("cosine").alias("cosine"))
    radius = F.when(F.col("n") == 1, 0.0).otherwise(F.acos(F.least(F.col("cosine"), F.lit(1.0))))
    classes = classes.select("class", "part", "n", radius.alias("radius")).join(led.select(F.col("row").alias("class"), "vec"), "class")
    judged = materialise(judge(candidates(members, listed=listed, shared=shared), classes, least), "class-pairs")
    partly = materialise(member_links(judged.where("not all"), members, led, least), "member-links")

    links = judged.where("all").select(F.col("a").alias("src"), F.col("b").alias("dst")).union(partly.select("a", "b").distinct())
    component = connected_components(links).select(F.col("node").alias("class"), "component")
    adds = judged.where("all").select(F.col("a").alias("class"), F.col("n_b").alias("n")).union(judged.where("all").select("b", "n_a")).groupBy("class").agg(F.sum("n").alias("adds"))
    # class figures go to the members by (class, leader): a hot class has many leaders, a leader at most CHUNK rows
    groups = members.groupBy("class", "leader").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    whole = groups.groupBy("class").agg(F.sum("n").alias("n"), F.min("least_id").alias("least_id")).join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    figures = whole.join(named, "component").join(adds, "class", "left").select("class", "component_id", (F.col("n") - 1 + F.coalesce("adds", F.lit(0))).alias("wide"))
    by_leader = groups.select("class", "leader").join(figures, "class")
    own = partly.groupBy("row").agg(F.sum("n").alias("single"))
    out = members.select("row", "vec_id", "class", "leader").join(by_leader, ["class", "leader"]).join(own, "row", "left")
    out = out.select("vec_id", (F.col("wide") + F.coalesce("single", F.lit(0))).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(alone).withColumnRenamed("vec_id", id_col)


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
