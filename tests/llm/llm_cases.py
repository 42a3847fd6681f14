"""Small document tables with the cases that every operator must bear."""

LONG = " ".join(f"word{i} of a very long text with number {i * i}." for i in range(6000))
SAME = "The quick brown fox jumps over the lazy dog and then it walks home through the dark forest alone."

# doc_id, text, lang, source
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\f\r ", None, None),
    (4, LONG, "en", "a"),
    (5, SAME, "en", "a"),
    (6, SAME + "  \n", "en", "b"),
    (7, SAME.upper(), "en", "b"),
    (8, "\n".join([SAME, "short", SAME, ""]), "en", "b"),
    (8, "\n".join([SAME, "short", SAME, ""]), "en", "b"),
    (9, "İstanbul é́ 中文字 😀 naïve\nÀ LA carte  K", "fr", "c.fr"),
    (10, SAME, None, "b"),
    (11, "\n\n" + SAME + "\n x", "en", "b"),
    (None, SAME + " and more words follow here for the one without an id", "en", "a"),
    (-12, SAME, "xx", "a"),
]

COLUMNS = "doc_id long, text string, lang string, source string"

# Names that the operators use for columns of their own.
CLASHING = ["row_no", "text_key", "keep", "rest", "result", "_row", "words", "items", "windows", "signature", "kept", "_language", "n_chars"]


def documents(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES if rows is None else rows, COLUMNS).repartition(3)
    return df.withColumns({c: F.lit("x") if c != "n_chars" else F.length("text").cast("long") for c in CLASHING})


def empty(spark):
    return documents(spark, [])


def texts(rows=None):
    return [(r[0], r[1] or "") for r in (EDGES if rows is None else rows)]
