"""Columns of the documents may have the names that operators give to columns of their own on the way."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from llm.conftest import ODD
from pyspark.sql import functions as F

from shelfscope.llm import decontaminate, line_dedup, near_dups, toxicity
from shelfscope.llm.base import free

FOLDER = "/root/testdata/sf0.01"
HELPERS = "__id __HASH __chunks __removed __Removed_ __n __d1 __d2 __e1 __matches __toxic __digest __found __text __words c0 id node words".split()


def test_free():
    assert free("__n", ["a"]) == "__n" and free("__n", ["__N", "__n_"]) == "__n__"


@pytest.mark.parametrize("operator", ["line_dedup", "near_dups", "benchmarks", "toxic", "toxic_joined"])
def test_same_rows_beside_clashing_columns(spark, docs_of, operator):
    item = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pydict()["text"][0]
    shared = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([*ODD, (30, item), (40, shared), (41, f"a\n{shared}"), (42, f"{shared} z")])
    clashing = docs.withColumns({name: F.lit(f"own {name}") for name in HELPERS})
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    apply = {
        "line_dedup": lambda d: line_dedup.line_dedup(d).select(d.columns),
        "near_dups": near_dups.without_near_duplicates,
        "benchmarks": lambda d: decontaminate.without_benchmarks(d, items),
        "toxic": lambda d: toxicity.without_toxic(d, labels),
        "toxic_joined": lambda d: toxicity.without_toxic(d, labels, table_words=0),
    }[operator]
    expected, got = apply(docs), apply(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert all(r[name] == f"own {name}" for r in rows for name in HELPERS)
    assert sorted(map(repr, got.select(docs.columns).collect())) == sorted(map(repr, expected.collect()))
    assert rows


def test_count_of_lines_beside_a_column_of_its_name(docs_of):
    docs = docs_of([(1, "a")]).withColumn("__removed", F.lit("own"))
    assert line_dedup.line_dedup(docs).columns == [*docs.columns, "__removed_"]
