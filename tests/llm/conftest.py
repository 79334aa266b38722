import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, component string, mix int"


def rows_of(texts, sources=None):
    """Rows of documents with further columns whose names the operators use themselves."""
    return [
        (i, t, "en", sources[k] if sources else f"s{k % 3}", None if t is None else len(t), "x", 7, "y", 1)
        for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts, sources=None: spark.createDataFrame(rows_of(texts, sources), SCHEMA)


def sentence(seed, n, salt=0):
    """``n`` invented words, the same for the same seed."""
    return [f"w{(seed * 7919 + k * 104729 + salt) % 5003}" for k in range(n)]
