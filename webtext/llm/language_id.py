"""Language identification by hierarchical discrimination with linear support vector machines.

Features of a text are its letter trigrams (lower-cased, other characters as
one space), hashed to ``DIM`` counts; the square roots of the shares make a
vector of length one. A first level of one-versus-one linear support vector
machines chooses the language family; a second level, one machine for each
pair of languages of that family, chooses the language. A language outside the
table of families is a family of its own. The machines are trained with hinge
loss by dual coordinate descent on at most ``per_language`` labelled texts of
each language, drawn by a hash of the id; learning uses text and label only.

The score is the product of the shares of the votes, each vote weighted by the
logistic function of its margin: 1 for a sure choice of both levels. The best
share of a level is never less than 0.5 (the mean share of its labels),
so no text with a letter scores less than 0.25, letter noise included.

Defined results: a null text, or one without a letter (Unicode class L), is
``und`` with score 0; so is every text if nothing was learned. Very long texts
are read whole, in parts. Ties go to the first label in alphabetical order. An
empty table gives no rows. Rows without a label are predicted but teach
nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtext.llm.common import ship, table

DIM, PART, PER_LANGUAGE, ROUNDS, COST, SLOPE = 4096, 1 << 20, 500, 30, 10.0, 4.0
UNKNOWN = "und"

FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}

_LETTER = np.zeros(0x110000, bool)
_LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True


def trigram_counts(text: str) -> np.ndarray:
    """Hashed letter trigrams of the whole text; every run of other characters is one space."""
    counts = np.zeros(DIM, np.int64)
    tail = np.array([32], np.uint32)
    text = text.lower()
    for start in range(0, len(text), PART):
        c = np.frombuffer(text[start:start + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(_LETTER[c], c, np.uint32(32))
        c = np.concatenate([tail, c, np.array([32], np.uint32)] if start + PART >= len(text) else [tail, c])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        counts += np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIM)
        tail = c[-2:]
    return counts


def features(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        counts = trigram_counts(t)
        x[i] = np.sqrt(counts / max(1, counts.sum()))
    return x


def train_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (last: bias) of a linear support vector machine, y in {-1, 1}; dual coordinate descent."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w, a = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    square, rng = (x**2).sum(axis=1), np.random.default_rng(3)
    cost = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))  # classes weigh the same
    for _ in range(ROUNDS):
        most = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(a[i] - (y[i] * float(x[i] @ w) - 1) / square[i], 0.0), cost[i])
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                most, a[i] = max(most, abs(new - a[i])), new
        if most < 1e-3:
            break
    return w


@dataclass
class Level:
    """One-versus-one machines over ``labels``."""

    labels: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray) -> Level:
        labels = sorted(set(y))
        pairs = list(itertools.combinations(range(len(labels)), 2))
        weights = np.zeros((len(pairs), DIM + 1), np.float32)
        for k, (i, j) in enumerate(pairs):
            own = np.flatnonzero((y == labels[i]) | (y == labels[j]))
            weights[k] = train_machine(x[own], np.where(y[own] == labels[i], 1, -1))
        return cls(labels, pairs, weights)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label number and score of every row."""
        votes = np.zeros((len(x), len(self.labels)))
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-SLOPE * np.clip(margin, -50, 50)))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += sure[:, k]
            votes[:, j] += 1 - sure[:, k]
        best = votes.argmax(axis=1)
        return best, votes[np.arange(len(x)), best] / (len(self.labels) - 1)


@dataclass
class Hierarchy:
    families: Level
    languages: dict[str, Level]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self.families.predict(x)
        label = np.empty(len(x), object)
        for f, name in enumerate(self.families.labels):
            own = np.flatnonzero(family == f)
            if len(own):
                level = self.languages[name]
                best, sure = level.predict(x[own])
                label[own] = np.array(level.labels, object)[best]
                score[own] *= sure
        return label, score


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, families: dict[str, str] = FAMILIES) -> Hierarchy | None:
    """Train on at most ``per_language`` texts of each label; None if there is none.

    The labels are counted first, so that about twice the bound of rows of a
    label reaches the ranking. Only hashed trigram features come to the driver:
    ``per_language`` times DIM floats for a label.
    """
    ship(labelled)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("label").isNotNull()).withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for label, n in counts.items() for v in (label, min(1.0, (2 * per_language + 50) / n))])
    few = rows.where(F.col("draw") < F.element_at(share, F.col("label"))).where(has_letter(F.col("text")))
    best = Window.partitionBy("label").orderBy("draw", "id")
    few = few.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_language)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": [x.tobytes() for x in features(b["text"].tolist())]})

    found = few.select("text", "label").mapInPandas(run, "label string, x binary").toPandas()
    if not len(found):
        return None
    order = np.lexsort((found["x"].to_numpy(), found["label"].to_numpy()))  # the same machines for any partitioning
    x = np.frombuffer(b"".join(found["x"].iloc[order]), np.float32).reshape(-1, DIM)
    y = found["label"].to_numpy()[order]
    family = np.array([families.get(label, label) for label in y], object)
    return Hierarchy(Level.train(x, family), {f: Level.train(x[family == f], y[family == f]) for f in sorted(set(family))})


def predict_language(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", label_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the predicted language and score."""
    spark = ship(docs)
    shared = spark.sparkContext.broadcast(model)  # bounded: DIM floats for a pair of labels

    @F.pandas_udf("label string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        label, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        known = np.flatnonzero(texts.notna())
        if shared.value is not None:
            for s in range(0, len(known), 256):
                own = known[s:s + 256]
                label[own], score[own] = shared.value.predict(features(texts.iloc[own].tolist()))
        return pd.DataFrame({"label": label, "score": score})

    guess = predict(F.when(has_letter(F.col(text_col)), F.col(text_col)))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), guess.alias("guess"))
    return out.select("row.*", F.col("guess.label").alias(label_name), F.col("guess.score").alias(score_name))


def keep_known(docs: DataFrame, model: Hierarchy | None, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents that are not ``und``; a ``min_score`` above 0.25 also leaves out unclear ones."""
    guess = predict_language(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text")), model)
    return guess.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict_language(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
