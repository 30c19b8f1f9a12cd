import pytest

from boutline.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside: tables may carry columns of these names.
CLASHING = ["doc", "row", "words", "pos", "term", "found", "score", "size", "target", "rate", "class", "group", "spans", "kept", "n_words"]
CLASHING += ["__doc", "__text", "__spans", "__base", "__source", "__rate", "__copies"]


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must take: NULLs in every column, empty, blank and very long texts,
    repeated rows, equal ids, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000)) + " " + "x" * 200_000
    rows = [
        (1, "the cat sat on the mat and then it sat on the mat again today", "en", "a", 10),
        (1, "the cat sat on the mat and then it sat on the mat again today", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n\x0b\x0c\r ", "en", None, 6),
        (5, long_text, "en", "b", len(long_text)),
        (6, "una casa en la calle de la ciudad con una puerta", "es", "b", 40),
        (6, "another text under the same number as the one before", "en", "b", 40),
        (None, "a row without a number has a text of its own here", "en", "c", 40),
        (None, None, None, None, None),
        (7, "12345 !!! ???", None, "c", 13),
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    return frame.selectExpr("*", *[f"doc_id AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
