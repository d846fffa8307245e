"""Small tables that hold the awkward cases: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (30, 80, 200, 45, 60)]
    passage = words(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, None), (11, ""), (12, "  \n\t "), (13, "one"), (14, "One two  three"), (15, base[1]), (16, base[1].upper()),
             (17, base[2] + " tail"), (18, "head " + base[2]), (19, words(rng, 25) + "\n" + passage + "\n" + words(rng, 15)),
             (20, passage + " " + words(rng, 30)), (21, words(rng, 5000, 3000) + " " + passage), (22, "ÄÖ é 日本語 naïve 🙂 " * 12),
             (23, "x " * 300), (24, "line a\nline a\n\nline b\nline a"), (25, "a" * 5000), (26, "MIT  License\nApache-License"),
             (27, "<|endoftext|> a \n\n<|endoftext|>b"), (30, base[3]), (30, base[3]), (30, base[4] + " other"), (None, base[0]),
             (None, None)]
    return [(i, t, None if i == 13 else "en", "s", None if t is None else len(t)) for i, t in rows]


def frame(spark, rows=None):
    """The table with extra columns whose names clash with those of results."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    clash = {c: F.lit("x") for c in ("n_words", "row", "ids", "words", "start", "doc", "part", "component_id", "h")}
    return df.withColumns(clash)
