import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Thand oner. " * 30_000

#: null id, null text, empty, blanks, very long, ties and repeated rows, odd characters
ROWS = [
    (1, "The and of THE and of the and of", "en", "a"), (2, None, "en", "a"), (3, "", None, "a"), (4, " \n\t", "de", None),
    (5, LONG, "en", "b"), (6, "x", "fr", "b"), (7, "same text here", "en", "b"), (7, "same text here", "en", "b"),
    (8, "same  text here", "en", "c"), (9, "Same text\nhere", "en", "c"), (None, "same text here", "en", "c"),
    (None, None, None, None), (10, "Licensed under CC BY-NC 4.0. All rights reserved. All rights\nreserved cc-by", "en", "d"),
    (11, "İK cc K by 漢字 naïve Straße\x1c\x85 😀😀 12345 'll we're", "de", "d"),
    (12, "line one\nline one\n\nline one\nother <b>#*</b>", "en", "d"), (13, "é " * 80, "es", "d"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in ROWS]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def clashing(edge):
    """The same rows with extra columns named as operators name theirs."""
    from pyspark.sql import functions as F
    names = ["row", "id", "key", "digest", "words", "host", "kept", "fp", "pass", "weight", "ids", "decoded", "n_words", "body"]
    return edge.select("*", *[F.lit("x").alias(n) for n in names])


def by_id(rows, key="doc_id"):
    return sorted(rows, key=lambda r: (r[key] is None, r[key] or 0, str(r)))
