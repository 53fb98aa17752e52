"""The views over the star schema: gold folded without part columns, offers made once for all that read them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfscope.catalog import market
from shelfscope.functions import stats
from shelfscope.operators import analytics as A
from shelfscope.operators import explore as X
from shelfscope.operators import matching as M
from shelfscope.operators import search
from shelfscope.plans.views import gold_view, offers_view
from shelfscope.session import materialise

LINES = [
    (o, part, supplier, line, quantity, price)
    for o, part, supplier, line, quantity, price in [
        (1, 1, 1, 1, 2.0, 10.0), (1, 2, 2, 2, 1.0, 7.0), (2, 1, 2, 1, 4.0, 10.0), (2, 1, 1, 2, 1.0, 9.0), (3, 3, 1, 1, 0.0, 5.0),
        (3, 2, 1, 2, 3.0, None), (4, 4, 2, 1, 1.0, 1.0), (1, None, 1, 3, 1.0, 2.0), (2, 5, 2, 3, 2.0, 8.0), (3, 5, 2, 3, 2.0, 8.0),
        (3, 1, 1, 4, None, 9.0), (1, 1, 1, 1, 2.0, 10.0),
    ]
]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Small tables with repeated and missing rows: part 1 is listed under two names, part 4 and order 4 nowhere, part 5 twice alike."""
    folder = str(tmp_path_factory.mktemp("star"))
    tables = {
        "region": ([(1, "ASIA"), (2, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(1, "N1", 1), (2, "N2", 2)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 1), (2, 2), (3, 2), (3, 2)], "c_custkey long, c_nationkey int"),
        "supplier": ([(1, 1), (2, 2)], "s_suppkey long, s_nationkey int"),
        "part": (
            [(1, "hot ring", "b1", "LARGE", 3), (1, "ring", "b2", "SMALL", None), (2, None, None, "PROMO", 1), (3, "tea", "b1", None, 2)]
            + [(5, "old bolt", "b3", "LARGE", 4)] * 2,
            "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
        ),
        "orders": ([(1, 1), (2, 2), (3, 3)], "o_orderkey long, o_custkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    lines = spark.createDataFrame(
        LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    )
    day = F.expr("timestamp'1996-01-02 00:00:00' + make_interval(0, 0, 0, cast(l_orderkey as int))")
    lines.withColumn("l_shipdate", day).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_gold_is_folded_without_part_columns_to_the_same_products(spark, star):
    gold = gold_view(spark, star).drop("processed_at")
    folds = [line for line in plan(gold).splitlines() if "Aggregate(key" in line and "city#" in line]
    assert folds and not any("length(" in line for line in folds)
    rows = offers_view(spark, star).withColumn("name", F.col("title"))
    want = M.assemble_gold(M.best_offer(rows, ["product_id"]), ["product_id"]).drop("processed_at")
    assert sorted(map(repr, gold.collect())) == sorted(map(repr, want.collect()))
    sizes = {r.product_id: (r.title, r.cluster_size) for r in gold.collect()}
    # Order 3 has a customer that is listed twice, part 1 two names, part 5 two copies.
    assert sizes == {1: ("ring", 12), 2: ("", 3), 3: ("tea", 2), 5: ("old bolt", 6)}


@pytest.mark.parametrize("name", ["is_lowest_without_prices", "dominance_without_prices", "dominance_index", "store_scorecard", "category_dominance"])
def test_offers_are_made_once(spark, star, monkeypatch, name):
    made = []

    def watched(df, *more):
        made.append("l_orderkey" in plan(df))
        return materialise(df, *more)

    for module in (market, A, stats):
        monkeypatch.setattr(module, "materialise", watched)
    result = market.QUERIES[name](spark, star)
    assert sum(made) == 1 and "l_orderkey" not in plan(result)


GOLD = "product_id string, title string, brand string, category string, offers array<struct<store:string,city:string,price:double>>"


def test_filter_values_land_only_values(spark, monkeypatch):
    gold = spark.createDataFrame(
        [("1", "a", "b", "c1", [("S", "X", 1.0), ("T", None, 2.0)]), ("2", "a", "b", "c2", []), ("3", "a", "b", None, None)], GOLD
    )
    landed = []
    monkeypatch.setattr(X, "materialise", lambda df: landed.append(df.columns) or materialise(df))
    got = {tuple(r) for r in X.filter_values(gold).collect()}
    assert {g for g in got if g[0] == "city"} == {("city", "X", True), ("city", None, True)}
    assert {g[1] for g in got if g[0] == "category"} == {"c1", "c2", None}
    assert landed and not any("offers" in columns for columns in landed)


def test_index_makes_the_gold_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    counted = F.udf(count, "string").asNondeterministic()
    gold = spark.createDataFrame([(str(i), f"hot anvil {i}", "b", "c", [("S", "X", 1.0)]) for i in range(20)], GOLD)
    search.write_index(gold.withColumn("title", counted("title")), str(tmp_path))
    # The rebalance of the parts may look at the rows once; the grams do not make them again.
    assert seen.value == 20
    assert search.candidates(spark, str(tmp_path), "anvil 1").count() == 11
