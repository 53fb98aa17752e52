"""Interactive queries over gold products, each for all cities or a chosen few.

A choice of cities means the same everywhere: products with an offer in one of
them, with all of their offers.  Only the market share, a count of offers, and
the ranking of markets look at the offers and markets of those cities alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.stats import group_quantiles
from shelfscope.session import materialise

# --- Fixed values ---
DEFAULT_CATEGORIES = 5  # categories preselected in the filter
SEARCH_RESULTS = 15  # products shown per search
# --- end of fixed values ---


def region_filter(gold: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """Products with an offer in one of the cities; all products by default."""
    if cities is None:
        return gold
    return gold.filter(F.exists("offers", lambda o: o["city"].isin(*cities)))


def city_values(gold: DataFrame) -> DataFrame:
    """Distinct cities of all offers."""
    return gold.select(F.explode("offers.city").alias("city")).distinct()


def category_values(gold: DataFrame, preselected: int = DEFAULT_CATEGORIES) -> DataFrame:
    """Distinct categories in order, the first few marked as preselected."""
    names = gold.select("category").distinct()
    chosen = names.orderBy("category").limit(preselected).withColumn("selected", F.lit(True))
    return names.join(chosen, "category", "left").select(
        "category", F.coalesce("selected", F.lit(False)).alias("selected")
    )


def filter_values(gold: DataFrame) -> DataFrame:
    """Values of both filters as (filter, value, selected); every city is preselected."""
    # The gold is read once, down to the distinct offers' cities of each category.
    seen = materialise(
        gold.select("category", F.posexplode_outer("offers.city").alias("_at", "city"))
        .select("category", "city", F.col("_at").isNotNull().alias("_offered"))
        .distinct()
    )
    cities = seen.filter("_offered").select("city").distinct()
    cities = cities.select(F.lit("city").alias("filter"), F.col("city").alias("value"), F.lit(True).alias("selected"))
    categories = category_values(seen).select(
        F.lit("category").alias("filter"), F.col("category").alias("value"), "selected"
    )
    return cities.unionByName(categories)


def kpis(gold: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """Products, brands, products with several offers and their share, mean relative spread."""
    gold = region_filter(gold, cities)
    spread = F.when(F.col("min_price") > 0, (F.col("max_price") - F.col("min_price")) / F.col("min_price"))
    several = F.sum((F.size("offers") > 1).cast("long"))
    return gold.agg(
        F.count(F.lit(1)).alias("products"),
        F.countDistinct("brand").alias("brands"),
        several.alias("matched_products"),
        F.try_divide(several * 100.0, F.count(F.lit(1))).alias("match_rate"),
        F.try_divide(F.coalesce(F.sum(spread), F.lit(0.0)), F.count(F.lit(1))).alias("avg_spread"),
    )


def dominance_ranking(scorecard: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """Stores and cities by dominance, highest first; ties by name."""
    if cities is not None:
        scorecard = scorecard.filter(F.col("city").isin(*cities))
    return scorecard.orderBy(F.desc("ldi"), "store", "city")


def market_share(gold: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """Offers of each store and their share, most first."""
    offers = region_filter(gold, cities).select(F.inline("offers"))
    if cities is not None:
        offers = offers.filter(F.col("city").isin(*cities))
    counts = offers.groupBy("store").agg(F.count(F.lit(1)).alias("offers"))
    # One row per store is left: the total is a window over that table.
    return counts.withColumn(
        "share", F.col("offers") / F.sum("offers").over(Window.partitionBy(F.lit(1)))
    ).orderBy(F.desc("offers"), "store")


def category_prices(
    gold: DataFrame, categories: Sequence[str] | None = None, cities: Sequence[str] | None = None
) -> DataFrame:
    """Lowest price of each product with its category and the city of its first offer."""
    gold = region_filter(gold, cities)
    if categories is not None:
        gold = gold.filter(F.col("category").isin(*categories))
    return gold.select("category", F.col("offers")[0]["city"].alias("city"), F.col("min_price").alias("price"))


def category_price_distribution(
    gold: DataFrame, categories: Sequence[str] | None = None, cities: Sequence[str] | None = None
) -> DataFrame:
    """Box summary of product prices per category and city."""
    keys = ["category", "city"]
    prices = category_prices(gold, categories, cities)
    counted = materialise(
        prices.filter(F.col("price").isNotNull()).groupBy(*keys, "price").agg(F.count(F.lit(1)).alias("_copies"))
    )
    return group_quantiles(
        counted,
        keys,
        "price",
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
        weight="_copies",
        moments={"min": F.min("price"), "max": F.max("price"), "products": F.sum("_copies")},
    ).select(*keys, "products", "min", "q1", "median", "q3", "max")


def category_volatility(
    gold: DataFrame, categories: Sequence[str] | None = None, cities: Sequence[str] | None = None
) -> DataFrame:
    """Sample deviation of product prices per category, highest first."""
    return (
        category_prices(gold, categories, cities)
        .groupBy("category")
        .agg(F.stddev_samp("price").alias("price_volatility"))
        .orderBy(F.desc_nulls_last("price_volatility"), "category")
    )


def product_search(
    gold: DataFrame, query: str, n: int = SEARCH_RESULTS, order: str = "product_id", cities: Sequence[str] | None = None
) -> DataFrame:
    """Products whose title or brand contains the query, ignoring case; the first few."""
    gold = region_filter(gold, cities)
    needle = F.lower(F.lit(query))
    hit = F.lower("title").contains(needle) | F.lower("brand").contains(needle)
    return gold.filter(hit).orderBy(order).limit(n)


def ranked_offers(gold: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """Offers of each product, cheapest first, the cheapest flagged.

    The ranking happens inside the product's own list: nothing is shuffled.
    """
    gold = region_filter(gold, cities)
    cheapest = F.array_min(F.transform("offers", lambda o: o["price"]))
    by_price = F.array_sort(
        F.transform(
            "offers",
            lambda o, i: F.struct(
                o["price"].alias("price"), i.alias("pos"), o["store"].alias("store"), o["city"].alias("city")
            ),
        )
    )
    return gold.select(
        "product_id", "title", cheapest.alias("_cheapest"), F.posexplode(by_price).alias("_rank", "_o")
    ).select(
        "product_id",
        "title",
        (F.col("_rank") + 1).alias("rank"),
        F.col("_o.store").alias("store"),
        F.col("_o.city").alias("city"),
        F.col("_o.price").alias("price"),
        (F.col("_o.price") == F.col("_cheapest")).alias("is_cheapest"),
    )
