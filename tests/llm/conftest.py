import pytest


def table(spark, rows, extra=True):
    """(doc_id, text) rows with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("key", "did", "th", "line", "block", "n", "lang", "source", "component_id"):
            df = df.withColumn(c, F.lit("x"))
        df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return df


LONG = "a line of more than twenty characters"
#: Nulls in every column, empty and very long texts, ties, repeated rows and ids.
ROWS = [
    (1, f"{LONG}\nshort\n{LONG}"), (2, f"  {LONG.upper()}\t\nown words of document two here"), (3, f"{LONG}\r\nthird"), (3, f"{LONG}\r\nthird"), (4, None), (5, ""), (6, "\n\n"),
    (None, f"{LONG}\nno id"), (7, "é" * 20 + "\n" + LONG), (8, "word " * 30_000), (9, "x"), (10, "one two three four five six seven eight nine ten"), (11, "one two three four five six seven eight nine ten"),
    (12, "One two three four five six seven eight nine ten eleven"), (2, "another text under a repeated id"), (13, "mail joe@x.example.com now"), (14, "�\x00\x01 odd \U0001f600"),
]


@pytest.fixture
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture
def empty(spark):
    return table(spark, [])
