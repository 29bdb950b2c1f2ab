"""Small tables with everything that can go wrong, and plain versions of the definitions."""

import random
import re

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Names that operators use themselves.
CLASHES = ["score", "predicted", "node", "spans", "n_words", "items", "g", "band", "hash", "a", "b", "root", "kept", "share"]
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType()),
                    *[T.StructField(c, T.StringType()) for c in CLASHES]])


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def docs_of(spark, rows):
    """rows of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *CLASHES) for i, t in rows], DOC)


def odd_rows():
    long_text = prose(7, 12_000)
    return [(1, prose(1, 120)), (2, None), (3, ""), (4, "   \n\t "), (5, long_text), (6, long_text), (7, prose(1, 120)),
            (7, prose(1, 120)), (None, prose(2, 80)), (None, None), (8, "one two"), (9, "one two"), (10, "\u2581 \U0001F600 a\u0000b é"),
            (11, "x" * 5000)]
