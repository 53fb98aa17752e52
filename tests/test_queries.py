"""Registered queries: coverage, a sample against SQL, and the shape of some plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracles import compare, connect
from shelfscope import catalog
from shelfscope.operators import analytics, cleaning, matching
from shelfscope.plans.views import listing_view, offers_view

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "extract_cards_by_ladder",
    "merge_extractions",
    "discover_leaf_categories",
    "normalize_listing",
    "clean_listings",
    "read_raw_listings",
    "leader_clusters_token_sort_70",
    "resolve_entities",
    "match_listings",
    "store_scorecard",
    "city_correlation",
    "report_tables",
    "kpis_in_region",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, SMALL, name)
    assert verdict.startswith("ok"), verdict


def test_every_query_has_its_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert set(entry.queries()) >= set(catalog.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_offers_read_only_what_they_need(spark):
    text = plan(offers_view(spark, SMALL).filter(F.col("category") == "PROMO").select("product_id", "price"))
    assert "l_tax" not in text and "o_totalprice" not in text
    assert "EqualTo(p_type,PROMO)" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_copies_are_limited_before_the_shuffle(spark):
    text = plan(cleaning.dedup_first(listing_view(spark, SMALL)))
    assert text.count("WindowGroupLimit") == 2


def test_top_categories_need_no_full_sort(spark):
    cats = spark.createDataFrame([("a", 1.0)], "category string, cat_ldi double")
    assert "TakeOrderedAndProject" in plan(analytics.top_categories(cats))


def test_candidates_are_an_equi_join(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, "kg", "tea", 1)], "block_category string, block_quantity double, block_unit string, form string, ord long"
    )
    text = plan(matching.similar_titles(rows))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_ratios_of_the_market_index_need_no_join_back(spark):
    text = plan(analytics.store_price_index(offers_view(spark, SMALL).select("store", "city", "category", "price", "unit_price")))
    assert "NestedLoop" not in text
