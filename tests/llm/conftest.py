from __future__ import annotations

import tracemalloc

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(i, r, "en", "s", None) if r is None or isinstance(r, str) else (*r, None) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    rows = [
        (1, None, None, None), (2, "", "en", None), (3, " \n\t", None, "a"), (4, "the same words again and again", "en", "a"),
        (5, "the same  words again\nand again", "en", "b"), (5, "the same  words again\nand again", "en", "b"), (None, "no id here", "de", "b"),
        (6, "x" * 200_000, "en", "c"), (7, "word " * 30_000, "fr", "c"), (8, "été \U0001f600 ß", "fr", "a"), (9, "42 17 %%", "en", "a"),
    ]
    df = make(rows)
    for name in ("id", "fp", "row", "shard", "score", "kept", "size", "text_sha256", "_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture
def sent(spark, monkeypatch):
    """The functions given to mapInArrow, in turn."""
    frame, functions = type(spark.range(0)), []
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: functions.append(f) or real(self, f, *a, **k))
    return functions


@pytest.fixture(scope="session")
def held():
    """Rows that a function makes of one Arrow batch, and how many MB of its own it holds meanwhile at most."""

    def measure(function, batch):
        tracemalloc.start()
        try:
            rows = sum(len(b) for b in function(iter([batch])))
            return rows, tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    return measure
