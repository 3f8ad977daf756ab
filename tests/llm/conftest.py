from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture
def make(spark):
    """documents from (doc_id, text[, lang, source])."""

    def frame(*rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return frame


@pytest.fixture
def odd(make):
    """Nulls, empty and blank texts, repeats, and a long one."""
    words = " ".join(f"w{i}" for i in range(60))
    return make((1, words), (1, words), (2, None), (3, ""), (4, " \n\t "), (None, words + " x"), (5, "a b c", None, None), (6, " ".join(f"v{i % 977}x{i}" for i in range(30_000))))
