import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, node string"


def rows(*texts, first=0, lang="en"):
    """Rows with columns whose names clash with those of results."""
    return [(first + i, t, lang, "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    def make(*texts, first=0, extra=()):
        return spark.createDataFrame([*rows(*texts, first=first), *extra], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Null id, null and empty texts, white space, one very long text, repeated rows."""
    long = "word " * 60_000 + "x" * 30_000
    same = (3, "again and again", "en", "s", 15, "x", "y", "z")
    return docs(None, "", " \n\t ", "again and again", long, "Ünï 漢字 <|endoftext|> 😀", extra=[same, (None, "no id", None, None, None, None, None, None), (9, "again and again", "de", "s", 1, "x", "y", "z")])


@pytest.fixture(scope="session")
def none(docs, spark):
    return spark.createDataFrame([], SCHEMA)
