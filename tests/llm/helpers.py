"""Small inputs with the awkward cases that every operator must bear."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("score", "id", "token", "hits", "count", "spans", "h", "c", "body", "k", "length")),
])


def docs(spark, rows):
    """(doc_id, text) rows with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, None, None, len(t) if t else None, *["x"] * 11) for i, t in rows], DOCS)


PASSAGE = " ".join(f"pass{i}" for i in range(60))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "two words"), (7, "long " * 40_000), (None, "no id " * 9), (8, PASSAGE), (9, f"before {PASSAGE} after"), (9, f"before {PASSAGE} after"),
    (10, PASSAGE), (11, "é ß 文字 " * 20), (12, "\x00\x1c\u0085 odd   space"), (13, f"{PASSAGE} tail one two three four"), (14, "a b c d e f g h i j k l m n o p"),
]
