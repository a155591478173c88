import pytest

NASTY = [None, "", " ", "\n\t", "a", "é" * 40, "<|im_end|>", "word " * 3000, "\x00\x01", "😀 mixed ñ TEXT 123", "x" * 5000]


@pytest.fixture
def nasty(spark):
    """Null, empty, long and odd texts, repeated rows, a null id, and extra columns whose names clash with inner ones."""
    rows = [(i, t, None, None) for i, t in enumerate(NASTY)] + [(4, "a", "x", 1), (None, "null id", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, token string, n long")


def check_rows(out, docs, key="doc_id"):
    """A row per row of the input."""
    assert sorted(str(r[0]) for r in out.select(key).collect()) == sorted(str(r[0]) for r in docs.select(key).collect())
