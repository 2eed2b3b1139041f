"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("digest", T.IntegerType())])

SYLLABLES = {"en": "the ing and of tion er wh ou".split(), "de": "der ung sch ü und lich zu ß".split(), "fr": "eau que é è ment tre ou ç".split(), "es": "ción ado os ñ ll rr que í".split()}


def sentence(rng, lang="en", words=12):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def documents(seed=0, n=60):
    """Rows of DOCS: random texts, exact and near copies, shared passages and the awkward ones."""
    rng = random.Random(seed)
    texts = [(sentence(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 120))) for _ in range(n)]
    passage = sentence(rng, "en", 60)
    for i in range(0, n, 5):
        texts[i] = texts[i] + " " + passage + " " + sentence(rng, "fr", 5)
    texts += [texts[3], texts[3], texts[4].replace("the", "The", 1), texts[7] + " x"]
    texts += [None, None, "", " \n\t", "1234 ...", "a", "ab " * 4000, "x" * 3000, "x" * 3000, "日本語 текст ß " * 30, "<|endoftext|> ▁ a\x00b"]
    rows = [(i, t, "en", "s", 1, "r", 5) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[8], None, None, None, None, None), (2, texts[9], None, "s", 1, "r", 5)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)
