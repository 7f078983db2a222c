import pytest
from llm_texts import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, lead double, row int, at string, es string, terms string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty and very long texts, ties, repeats, and columns of clashing names."""

    def make(rows=None):
        if rows is None:
            long = words(1, 30_000)
            rows = [(1, None), (2, ""), (3, long), (4, long), (5, "one two"), (6, "one two"), (6, "one two"), (None, long), (7, "é ü 日本語 😀   \n\t!?"), (8, "..., !!!"), (9, words(2, 80)), (10, words(2, 80) + " tail")]
        out = [(i, t, "en" if i and i % 2 else None, None, len(t) if t is not None else None, "x", None, 1.0, None, "a", "b", "c", None) for i, t in rows]
        return spark.createDataFrame(out, SCHEMA)

    return make
