import random
import string

import pytest

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h1 long, fp string, pattern string, host string"


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names clash with inner ones."""
    rng = random.Random(5)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    long = "\n".join(prose(40) for _ in range(6000))  # over 2^20 bytes
    copied = prose(200)
    rows = [
        (1, copied, "en", "a.org", 5, 1, "x", "p", "h"),
        (2, copied, "en", "a.org", 5, 1, "x", "p", "h"),
        (2, copied, "en", "a.org", 5, 1, "x", "p", "h"),  # a repeated row
        (2, prose(60), "en", "a.org", 5, 1, "x", "p", "h"),  # an id that is not unique
        (3, "", "en", "b.org", 0, None, None, None, None),
        (4, None, None, None, None, None, None, None, None),
        (None, prose(30), "en", "b.org", None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
        (5, " \n\t\n \x0b\x0c\r", "en", "b.org", 8, 2, "y", "q", "i"),
        (6, long, "en", "a.org", 9, 3, "z", "r", "j"),
        (7, long[500_000:503_000] + prose(50), "en", "a.org", 9, 3, "z", "r", "j"),
        (8, "a" * 5000, "en", "a.org", 9, 3, "z", "r", "j"),
        (9, "één Ünïcode \U0001f600 token: abcdef0123 ünd so weiter " * 9, "nl", "c.org", 9, 3, "z", "r", "j"),
    ]
    rows += [(10 + i, prose(rng.randint(1, 120)), "en", f"{'abc'[i % 3]}.org", 1, i, "w", "s", "k") for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of a DataFrame's rows, null as empty."""
    return lambda df: [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
