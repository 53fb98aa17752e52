"""Market statistics against pandas on small offers with awkward values."""

from __future__ import annotations

import pandas as pd
import pytest

from shelfscope.operators import analytics as A
from shelfscope.operators import explore as X
from shelfscope.plans import jobs

SCHEMA = "product_id string, brand string, quantity double, category string, store string, city string, price double, unit_price double, ord long"
ROWS = [
    ("p1", "b1", 1.0, "c1", "S", "X", 10.0, 10.0, 1),
    ("p1", "b1", 1.0, "c1", "T", "X", 12.0, 12.0, 2),
    ("p1", "b1", 1.0, "c1", "S", "Y", 10.0, 10.0, 3),
    ("p2", "b2", 2.0, "c1", "S", "X", 0.0, 5.0, 4),
    ("p2", "b2", 2.0, "c1", "T", "X", 40.0, 20.0, 5),
    ("p3", "b1", 0.5, "c2", "T", "Y", 7.0, 14.0, 6),
    ("p4", "b3", 3.0, "c2", "T", "X", 9.0, 3.0, 7),
    ("p4", "b3", 3.0, "c2", "S", "X", 8.0, None, 8),
]


@pytest.fixture(scope="module")
def offers(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def frame():
    return pd.DataFrame(ROWS, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def test_dispersion(spark, offers):
    got = A.price_dispersion(offers).toPandas().set_index("product_id")
    single = got.loc["p3"]
    assert (single["std"], single["cv"], single["price_spread_ratio"], single["iqr"]) == (0, 0, 1, 0)
    assert got.loc["p2", "price_spread_ratio"] == 1.0
    for pid, g in frame().groupby("product_id"):
        assert got.loc[pid, "median"] == g.price.median()
        assert got.loc[pid, "iqr"] == pytest.approx(g.price.quantile(0.75) - g.price.quantile(0.25))
        assert got.loc[pid, "std"] == pytest.approx(g.price.std() if len(g) > 1 else 0.0)


def test_spread_of_zero_prices_is_undefined(spark):
    zero = spark.createDataFrame([("p", 0.0), ("p", 0.0)], "product_id string, price double")
    row = A.price_dispersion(zero).first()
    assert row["price_spread_ratio"] is None
    assert row["cv"] == 0


def test_scorecard(spark, offers):
    df = frame()
    local = df.groupby(["city", "category"]).unit_price.transform("mean")
    df["position"] = df.unit_price / local
    df["wins"] = df.price == df.groupby("product_id").price.transform("min")
    sizes = df.groupby("category").size()
    got = A.store_scorecard(offers).toPandas().set_index(["store", "city"])
    for key, g in df.groupby(["store", "city"]):
        row = got.loc[key]
        assert row["avg_category_price_index"] == pytest.approx(g.position.mean())
        assert row["price_volatility_score"] == pytest.approx(g.price.std(), nan_ok=True)
        assert row["median_price_deviation"] == pytest.approx((g.price - g.price.median()).abs().median())
        assert row["wins"] == g.wins.sum()
        assert row["ldi"] == pytest.approx(g.wins.sum() / 4)
        assert row["weighted_ldi"] == pytest.approx(g[g.wins].category.map(sizes).sum() / sizes.sum())
        assert row["leadership_frequency"] == pytest.approx(g.wins.mean())


def test_category_dominance_may_exceed_one(spark, offers):
    got = {(r["category"], r["store"]): r["cat_ldi"] for r in A.category_dominance(A.is_lowest(offers)).collect()}
    assert got == {("c1", "S"): 1.5, ("c1", "T"): 0.0, ("c2", "S"): 1.0, ("c2", "T"): 0.5}


def test_tiers_and_sync(spark, offers):
    df = frame()
    tiers = A.brand_tier(offers).toPandas().set_index(["brand", "category"])
    medians = df.groupby("category").unit_price.median()
    for key, g in df.groupby(["brand", "category"]):
        assert tiers.loc[key, "mean_unit_price"] == pytest.approx(g.unit_price.mean())
        assert bool(tiers.loc[key, "is_premium"]) == bool(g.unit_price.mean() > 1.5 * medians[key[1]])
    means = df.groupby(["product_id", "store"]).price.mean().reset_index()
    wide = means.pivot(index="product_id", columns="store", values="price").dropna(thresh=2)
    assert A.price_sync_score(offers).first()[0] == pytest.approx(wide.corr().mean().mean())


def test_sync_without_shared_products_is_zero(spark, offers):
    assert A.price_sync_score(offers.filter("store = 'S'")).first()[0] == 0.0


def test_city_matrix(spark, offers):
    profile = A.product_profile(offers)
    wide = profile.toPandas()
    got = A.city_correlation(profile).toPandas()
    for city, g in wide.groupby("city"):
        want = g[A.CITY_MEASURES].astype(float).corr().fillna(0)
        for r in got[got.city == city].itertuples():
            assert r.corr == pytest.approx(want.loc[r.var_x, r.var_y], abs=1e-9)


def test_null_keys_are_dropped(spark):
    rows = [(None, "b", 1.0, "c", "S", "X", 1.0, 1.0, 1), ("p", "b", 1.0, "c", None, "X", 1.0, 1.0, 2)]
    odd = spark.createDataFrame(rows, SCHEMA)
    assert A.price_dispersion(odd).count() == 1
    assert A.store_price_index(odd).count() == 1


GOLD = "product_id string, title string, brand string, quantity double, unit string, category string, offers array<struct<store:string,city:string,price:double,unit_price:double,timestamp:string>>, min_price double, max_price double, match_count long, cluster_size long, processed_at string"
PRODUCTS = [
    ("1", "Rose Soap", "Lux", 1.0, "kg", "Care", [("S", "X", 10.0, 10.0, ""), ("T", "Y", 8.0, 8.0, "")], 8.0, 10.0, 2, 2, ""),
    ("2", "Tea", "Rose", 1.0, "kg", "Drinks", [("S", "X", 5.0, 5.0, "")], 5.0, 5.0, 1, 1, ""),
    ("3", "Rice", "Ponam", 1.0, "kg", "Food", [], None, None, 0, 1, ""),
]


def test_exploration(spark):
    gold = spark.createDataFrame(PRODUCTS, GOLD)
    assert [r["product_id"] for r in X.product_search(gold, "ROSE").collect()] == ["1", "2"]
    assert X.region_filter(gold, ["Y"]).count() == 1
    k = X.kpis(gold).first()
    assert (k["products"], k["brands"], k["matched_products"]) == (3, 3, 1)
    assert k["avg_spread"] == pytest.approx(0.25 / 3)
    ranked = [(r["rank"], r["store"], r["is_cheapest"]) for r in X.ranked_offers(gold).filter("product_id = '1'").collect()]
    assert ranked == [(1, "T", True), (2, "S", False)]
    shares = [(r["store"], r["offers"], round(r["share"], 3)) for r in X.market_share(gold).collect()]
    assert shares == [("S", 2, 0.667), ("T", 1, 0.333)]
    assert A.explode_offers(gold).count() == 3


def test_analysis_job(spark):
    tables = jobs.analyze_market(spark.createDataFrame(PRODUCTS, GOLD))
    assert tables["product_dispersion_metrics"].count() == 2
    sections = {r["section"] for r in tables["report_tables"].select("section").distinct().collect()}
    assert sections == {"overview", "scorecard", "correlation", "city_matrix", "top_categories"}


def test_an_offer_without_a_price_wins_nothing(spark):
    gold = spark.createDataFrame(
        [("1", "Tea", "B", 1.0, "kg", "Drinks", [("S", "X", None, None, ""), ("T", "X", 5.0, 5.0, "")])],
        "product_id string, title string, brand string, quantity double, unit string, category string, "
        "offers array<struct<store:string, city:string, price:double, unit_price:double, timestamp:string>>",
    )
    offers = A.explode_offers(gold)
    rows = {r["store"]: (r["price"], r["is_lowest"]) for r in A.is_lowest(offers).collect()}
    assert rows == {"S": (None, False), "T": (5.0, True)}
