from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Extra columns carry names that operators use for results or keys of their own.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, in the columns of the table and some that clash."""

    def make(pairs):
        rows = [(i, x, "en", "s", None if x is None else len(x), "x", "y", "z", "k") for i, x in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


#: Null id, null and empty texts, white space, repeated rows, one id on two texts, a very long text, characters of many widths.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\x0c\r\n\n"),
    (None, "a text without an id"),
    (4, "repeated row"),
    (4, "repeated row"),
    (5, "same id"),
    (5, "other text"),
    (6, "word " * 60_000),
    (7, "Ünïcödé ẞ ǅ ١٢٣ 漢字かな 🎈👨‍👩‍👧     \x85 \x1c ՘ ᲊ x﻿"),
    (8, "0" * 50_000),
    (9, "\n".join(["line of some words"] * 30)),
]
