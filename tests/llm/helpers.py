"""Small tables for the tests of this folder."""

import random

from pyspark.sql import functions as F

#: Columns whose names the operators use themselves.
CLASHING = ("id", "node", "n", "sketch", "value", "spans", "kept", "score", "k1", "part", "arc", "rank", "order", "__key", "__same", "a.b")


def documents(spark, rows, clashing=True):
    """(doc_id, text, lang, source, n_chars) from (doc_id, text) or (doc_id, text, lang), and columns with clashing names."""
    full = [(i, t, rest[0] if rest else "en", "src", None if t is None else len(t)) for i, t, *rest in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clashing else df


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def edited(text, seed, every):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**9)}" if r.random() < 1 / every else w for w in text.split(" "))
