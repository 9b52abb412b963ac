import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, k int, label string, __text string, __key int"


def rows_of(texts, first=0):
    """Rows in the shape of documents with extra columns whose names clash with inner ones."""
    return [(i, t, "en", "s", None if t is None else len(t), "x", "y", 1, "z", "w", 2) for i, t in enumerate(texts, first)]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and blank texts, a very long one, copies, repeated rows and ids."""
    rng = random.Random(5)
    words = [rng.choice("the of and under token ein der und la de le règle 42 naïve x1".split()) for _ in range(30_000)]
    texts = ["", None, " \n\t ", "one", "one two", "ONE two three", " ".join(words), " ".join(words), "tail  of   spaces ", "日本語 テキスト です", "a" * 3000]
    texts += [" ".join(words[i * 40 : i * 40 + 60]) for i in range(30)]
    rows = rows_of(texts)
    nobody = (None, "text without an id", None, None, None, None, None, None, None, None, None)
    return [*rows, rows[3], rows[3], (5, "another text of the same id", None, None, None, "x", "y", 1, "z", "w", 2), nobody, nobody]


@pytest.fixture(scope="session")
def odd(frame, odd_rows):
    return frame(odd_rows)


@pytest.fixture(scope="session")
def none(frame):
    return frame([])


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}
