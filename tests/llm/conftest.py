import re

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use inside
                       *[T.StructField(n, T.StringType()) for n in ("_row", "_key", "key", "size", "host", "line", "words", "stretch", "copy", "item_id", "n", "starts")]])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def table(spark):
    """Rows of (doc_id, text, source) as a documents table with columns of clashing names."""
    def make(rows):
        return spark.createDataFrame([(d, t, "en", s, len(t or ""), *["x"] * 12) for d, t, s in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def edges():
    """NULLs everywhere, empty and white texts, ties, repeated rows, repeated ids, odd characters, a long text."""
    import random
    r = random.Random(3)
    vocab = ["the", "of", "Alpha", "beta", "gamma", "delta", "épsilon", "zeta,", "eta.", "the"] + [f"w{i}" for i in range(300)]

    def prose(n, seed):
        q = random.Random(seed)
        return " ".join(q.choice(vocab) + ("\n" if q.random() < 0.08 else "") for _ in range(n))
    base = prose(160, 1)
    rows = [(1, base, "a"), (2, base, "a"), (3, base + " tail words here", "b"), (3, base + " tail words here", "b"), (4, None, "a"), (5, "", None), (6, " \n\t ", "b"),
            (7, "one", "c"), (8, "one two three", "c"), (9, "one two three", None), (None, prose(70, 2), "a"), (None, None, None), (10, prose(90, 3), None),
            (10, prose(95, 4), "a"), (11, "same " * 300, "d"), (12, "😀 字字 \x00 ümlaut\x1cx\x85y  two   spaces \r\n" * 20, "é"), (13, prose(20000, 5), "long"),
            (14, "ein wort　noch " * 40, "b"), (15, prose(60, 6) + "\n" + base, "b"), (16, "x" * 30000, "d")]
    rows += [(100 + i, prose(r.randint(40, 120), 50 + i % 17) + f" {i % 3}", "abc"[i % 3]) for i in range(60)]
    return rows
