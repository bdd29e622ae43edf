"""Small texts with everything that real tables hold."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, h long, fingerprint string, label string"


def rows(spark, texts, sources=None):
    """Documents 0, 1, ... with the given texts, and columns whose names operators use inside."""
    sources = sources or ["a"] * len(texts)
    data = [
        (i, t, "en", s, len(t) if t is not None else None, 0.5, 7, 8, "x", "y") for i, (t, s) in enumerate(zip(texts, sources))
    ]
    return spark.createDataFrame(data, SCHEMA)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(words)]


LONG = " ".join(prose(99, 30_000, 5000))
ODD = [None, "", " \n\t ", "\n\n", "one", "One two", "é ü 漢字 ñ", "a" * 5000, "same line here\n" * 4, LONG, "tie tie tie", "tie tie tie", "\x00\x0b\x0c x\r\ny"]


def odd(spark):
    """Odd texts, a row that occurs twice, a row without id, rows without source and language."""
    base = rows(spark, ODD, ["a", None, "b", "", "ß", "a", None, "b", "c", "a", "a", "a", "z"])
    again = base.where("doc_id in (5, 10)")
    unknown = base.where("doc_id in (4, 9)").selectExpr("cast(null as long) as doc_id", *[c for c in base.columns if c != "doc_id"])
    return base.union(again).union(unknown)
