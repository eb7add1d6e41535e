import pytest

LONG = " ".join(f"word{i} of{i % 7} text{i % 11}." for i in range(3000))

#: Null, empty and blank texts, ties, repeated rows, one id with two texts, a null id, and clashing names.
ODD = [
    (1, None, "a", "x", 1, 2, 3),
    (2, "", "a", "x", 1, 2, 3),
    (3, " \t\n", "a", None, 1, 2, 3),
    (4, "one", "a", "x", 1, 2, 3),
    (5, "The same short text, which comes again and again in these rows of ours for the sake of a test or two.", "a", "x", 1, 2, 3),
    (6, "The same short text, which comes again and again in these rows of ours for the sake of a test or two.", "a", "y", 1, 2, 3),
    (6, "The same short text, which comes again and again in these rows of ours for the sake of a test or two.", "a", "y", 1, 2, 3),
    (7, LONG, "a", "y", 1, 2, 3),
    (8, LONG.replace("word17 ", "w0rd "), "a", "y", 1, 2, 3),
    (8, "another text of the same id é ü 中文", "a", "y", 1, 2, 3),
    (None, "a text without an id, and with enough words in it to be a proper sentence at that", "a", "y", 1, 2, 3),
    (9, "é" * 300 + "x", "a", "y", 1, 2, 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, d int, tag int, row int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
