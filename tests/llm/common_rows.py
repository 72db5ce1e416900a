"""Rows that every operator must survive, and a way to make tables of them."""

LONG = "ab12 cd-34 " * 20_000
ODD = [
    (None, "a text without an id and some more words", "s1"), (1, None, "s1"), (2, "", "s1"), (3, " \n\t ", None),
    (4, "Repeated row", "s2"), (4, "Repeated row", "s2"), (5, "REPEATED ROW", "s2"), (6, LONG, "s2"),
    (7, "é ß 漢字 \U0001f600 word joined   x", None), (8, "a\nb\na\n\na", "s3"), (9, "0" * 5000, "s3"),
]
SCHEMA = "doc_id long, text string, source string"


def odd(spark):
    """The rows, with columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "1 AS kept", "2 AS size", "3 AS hash", "4 AS key", "5 AS value", "'x' AS lang", "6 AS n_chars")


def empty(spark):
    return odd(spark).limit(0)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], SCHEMA)
