"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ta", "re", "mi", "so", "lu", "ne") for b in ("", "ka", "dor", "vin", "esh", "ul", "ong")]


def prose(rng, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    out = []
    for i in range(0, n, 9):
        out.append(" ".join(words[i : i + 9]).capitalize() + ".")
    return " ".join(out)


def texts(n=60, seed=1):
    """(doc_id, text): plain documents, then the awkward ones."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(30, 160))) for i in range(n)]
    base = rows[0][1]
    rows += [
        (n, base), (n + 1, base + " And more words at its end."), (n + 2, base.replace("ta", "TA", 1)), (n + 3, None), (n + 4, ""), (n + 5, "one two"), (n + 6, "é"),
        (n + 7, "  two  spaces \n\n and\ttabs  "), (n + 8, prose(rng, 9000)), (n + 8, "a second row of one id"), (n + 9, base), (n + 9, base), (None, "a row without an id, of some words"), (None, None),
        (n + 10, "<|endoftext|> in a text, naïve ﬁ ΑΣ İx 한국어 \x01 \u0301x"), (n + 11, "x" * 5000), (n + 12, "word " * 3000),
    ]
    return rows


def docs(spark, rows, clashing=False):
    df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        for name in ("score", "node", "start", "part", "ids", "votes", "a", "base", "key", "piece", "length"):
            df = df.withColumn(name, F.lit(name))
    return df
