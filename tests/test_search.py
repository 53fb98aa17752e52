"""The search index over landed products."""

from __future__ import annotations

import random

import pytest

from shelfscope.operators import explore, search
from shelfscope.schemas import GOLD

WORDS = ["green tea", "İstanbul", "100% juice", "rice", "Ricé", "a_b", "naïve", "ab", "", "aaaa", "tea"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    pick = random.Random(3)
    text = lambda: pick.choice([None, " ".join(pick.choices(WORDS, k=pick.randrange(4)))])
    city = lambda: [("S", pick.choice("XYZ"), 1.0, 1.0, "")]
    rows = [(f"{i:04d}", text(), text(), 1.0, "kg", "c", city(), 1.0, 1.0, 1, 1, "") for i in range(400)]
    gold = spark.createDataFrame(rows, GOLD)
    folder = str(tmp_path_factory.mktemp("index"))
    search.write_index(gold, folder)
    return gold, folder


@pytest.mark.parametrize("query", ["TEA", "green tea", "n t", "ab", "", "%", "a_b", "İST", "naïv", "ricé", "aaaaa", "tea tea", "none of it", "juice rice"])
def test_as_the_plain_search(spark, indexed, query):
    gold, folder = indexed
    for cities in (None, ["X"]):
        want = explore.product_search(gold, query, 50, cities=cities).collect()
        assert search.indexed_search(spark, folder, query, 50, cities=cities).collect() == want


def test_only_what_a_query_names_is_read(spark, indexed):
    _, folder = indexed
    text = search.candidates(spark, folder, "juice")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text and "PushedFilters: [In(gram" in text
    text = search.matching_products(spark, folder, "juice")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text


def test_no_products(spark, tmp_path):
    search.write_index(spark.createDataFrame([], GOLD), str(tmp_path / "none"))
    assert search.indexed_search(spark, str(tmp_path / "none"), "tea").count() == 0
