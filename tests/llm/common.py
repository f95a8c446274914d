"""Small tables for the training-data operators, and brute-force pieces they share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that the operators use as names of their own.
CLASH = ["did", "size", "score", "ids", "copies", "component_id", "seed", "src", "spans", "fp", "kept", "n_tokens",
         "row", "key", "text_", "__id", "__key", "__spans", "__h1", "__h2", "__g1", "__k0", "__k1", "__nth", "__copy", "__copies", "__text",
         "k0", "k1", "learn", "block", "rows", "n", "data", "part", "n_a", "fast", "slow", "groups"]


def docs(spark, rows, parts=3):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)``, with columns of clashing names."""
    full = [(*r, *([None] * (3 - len(r))), "en", *(["x"] * len(CLASH))) for r in rows]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(full, schema).repartition(parts)


def with_map(df):
    """``df`` with a map and a list of maps, whose rows cannot be hashed."""
    from pyspark.sql import functions as F

    return df.withColumns({"tags": F.create_map(F.lit("id"), F.col("doc_id").cast("string")), "more": F.array(F.create_map(F.lit(1), F.lit("x")))})


def words(n, rng, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Nulls, empty, blank, very long, repeated and tied rows."""
    rng = random.Random(4)
    long = " ".join(words(60_000, rng))
    a = " ".join(words(80, rng))
    return [(None, a), (None, a), (1, None), (2, ""), (3, " \n\t "), (4, a), (5, a), (5, a), (6, long), (7, long + " end"),
            (8, "x " * 500), (9, "é" * 3000), (10, "one"), (11, "one two")]


def components(n, linked):
    """Smallest member reachable, per item."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in linked:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
