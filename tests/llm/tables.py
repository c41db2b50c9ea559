"""Small tables with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("th", "er", "on", "qu", "sch", "ment", "ci") for b in ("a", "ing", "ou", "ung", "é", "s", "tion", "o", "en")]
LONG = " ".join(random.Random(1).choice(WORDS) for _ in range(40_000))
EDGES = [(None, "no id here at all", "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "fr"), (4, "word", "de"), (5, LONG, "es"), (6, "a b c d", "en"), (6, "a b c d", "en"), (7, "日本 🙂 \x00 text", None), (2**62, "a b c d", "en"), (-4, "a b c d e", None)]


def edges(spark):
    """doc_id, text, lang, and columns named like those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(c) for c in ("score", "key", "n", "a", "b", "to", "id", "cls", "slot", "part", "size", "lang_out", "spans", "held_out")})


def empty(spark):
    return edges(spark).limit(0)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))
