"""Market statistics over offer rows.

An offer row has product_id, title, brand, quantity, unit, category, store,
city, price, unit_price and ``ord``, the order of arrival.  Small-key metrics
(store, city, category) are rolled up from pre-aggregated cells, so the rows
are shuffled only after map-side combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.stats import attach, group_quantiles, nan_to_null, safe_corr, with_keys
from shelfscope.session import materialise

PREMIUM_FACTOR = 1.5  # fixed value: a brand is premium above this multiple of the category median
TOP_CATEGORIES = 10  # fixed value: length of the report's category list
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

# Numeric columns whose correlations are reported per city, in report order.
CITY_MEASURES = [
    "mean",
    "median",
    "std",
    "min",
    "max",
    "iqr",
    "cv",
    "price_range",
    "price_spread_ratio",
    "quantity",
    "competitor_count",
]


def explode_offers(gold: DataFrame) -> DataFrame:
    """One row per offer with its product's columns; products without offers vanish.

    Missing words and quantities take their defaults.  A missing price stays
    NULL: it is no price of 0 and wins nothing.
    """
    rows = gold.select("*", F.posexplode("offers").alias("offer_pos", "offer"))

    def or_default(name: str, default) -> F.Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name.split(".")[-1])

    return rows.select(
        or_default("product_id", ""),
        or_default("title", ""),
        or_default("brand", "Generic"),
        or_default("quantity", 1.0),
        or_default("unit", "unit"),
        or_default("category", "Unknown"),
        or_default("offer.store", ""),
        or_default("offer.city", ""),
        F.col("offer.price").alias("price"),
        F.col("offer.unit_price").alias("unit_price"),
        "offer_pos",
    )


def price_dispersion(offers: DataFrame) -> DataFrame:
    """Spread of the prices of each product."""
    price = nan_to_null(F.col("price"))
    stats = group_quantiles(
        offers.select("product_id", "price"),
        ["product_id"],
        "price",
        QUARTILES,
        moments={
            "mean": F.avg(price),
            "std": F.coalesce(F.stddev_samp(price), F.lit(0.0)),
            "min": F.min(price),
            "max": F.max(price),
        },
    )
    return stats.select(
        "product_id",
        "mean",
        "median",
        "std",
        "min",
        "max",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)).alias("cv"),
        (F.col("max") - F.col("min")).alias("price_range"),
        # x/0 counts as no spread, 0/0 stays undefined
        F.when((F.col("min") == 0) & (F.col("max") != 0), F.lit(1.0))
        .otherwise(F.try_divide("max", "min"))
        .alias("price_spread_ratio"),
    )


def relative_position(offers: DataFrame) -> DataFrame:
    """Unit price against the mean of its category, in its city and overall."""
    up = nan_to_null(F.col("unit_price"))
    sums = materialise(
        with_keys(offers, "category").groupBy("city", "category").agg(
            F.sum(up).alias("_sum"), F.count(up).alias("_n")
        )
    )
    overall = sums.groupBy("category").agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("global_cat_mean")
    )
    local = with_keys(sums, "city").select(
        "city", "category", F.try_divide("_sum", "_n").alias("local_cat_mean")
    )
    placed = attach(attach(offers, local, ["city", "category"], "left"), overall, ["category"], "left")
    return placed.withColumns(
        {
            "relative_price_position": F.try_divide("unit_price", "local_cat_mean"),
            "global_relative_position": F.try_divide("unit_price", "global_cat_mean"),
        }
    )


FLAGGED = ["product_id", "store", "city", "category", "price", "unit_price", "is_lowest"]


def is_lowest(offers: DataFrame) -> DataFrame:
    """Flag the offers at the lowest price of their product anywhere; ties all win."""
    lowest = with_keys(offers, "product_id").groupBy("product_id").agg(
        F.min(nan_to_null(F.col("price"))).alias("min_price")
    )
    flagged = attach(offers, lowest, ["product_id"])
    return flagged.withColumn("is_lowest", F.coalesce(F.col("price") == F.col("min_price"), F.lit(False)))


def flag_lowest_once(offers: DataFrame) -> DataFrame:
    """:func:`is_lowest` reduced to what the market metrics read, written once for all of them."""
    return materialise(is_lowest(offers).select(*FLAGGED))


def category_size(offers: DataFrame) -> DataFrame:
    """Offer rows per category."""
    return with_keys(offers, "category").groupBy("category").agg(F.count(F.lit(1)).alias("cat_size"))


def store_price_index(offers: DataFrame) -> DataFrame:
    """Mean relative price position and price volatility of each store and city."""
    up, price = nan_to_null(F.col("unit_price")), nan_to_null(F.col("price"))
    cells = with_keys(offers, "store", "city").groupBy("store", "city", "category").agg(
        F.sum(up).alias("_sum"),
        F.count(up).alias("_n"),
        F.count(price).alias("_prices"),
        F.avg(price).alias("_mean"),
        F.var_pop(price).alias("_var"),
    )
    # The city means come from the cells, so the offers are read only once.
    market = Window.partitionBy("city", "category")
    cells = cells.withColumn(
        "_position",
        F.when(
            F.col("category").isNotNull(),
            F.try_divide(F.col("_sum"), F.try_divide(F.sum("_sum").over(market), F.sum("_n").over(market))),
        ),
    )
    here = Window.partitionBy("store", "city")
    centre = F.try_divide(F.sum(F.col("_mean") * F.col("_prices")).over(here), F.sum("_prices").over(here))
    cells = cells.withColumn("_centre", centre)
    squares = F.sum(F.col("_prices") * (F.col("_var") + (F.col("_mean") - F.col("_centre")) ** 2))
    return cells.groupBy("store", "city").agg(
        F.try_divide(
            F.sum("_position"), F.sum(F.when(F.col("_position").isNotNull(), F.col("_n")))
        ).alias("avg_category_price_index"),
        F.when(F.sum("_prices") > 1, F.sqrt(squares / (F.sum("_prices") - 1))).alias("price_volatility_score"),
    )


def median_price_deviation(offers: DataFrame) -> DataFrame:
    """Median absolute deviation of the prices of each store and city."""
    keys = ["store", "city"]
    prices = offers.select(*keys, nan_to_null(F.col("price")).alias("price"))
    # Both medians are taken over distinct prices with their counts; there are
    # at most as many distinct gaps as prices.
    counted = materialise(with_keys(prices, *keys, "price").groupBy(*keys, "price").count())
    centre = group_quantiles(counted, keys, "price", {"_median": 0.5}, weight="count")
    gaps = materialise(counted.join(centre, keys).select(*keys, F.abs(F.col("price") - F.col("_median")).alias("gap"), "count"))
    return group_quantiles(gaps, keys, "gap", {"median_price_deviation": 0.5}, weight="count")


def dominance_index(flagged: DataFrame) -> DataFrame:
    """Wins and leadership shares of each store and city.

    ``flagged`` is the result of :func:`is_lowest`.
    """
    wins = F.sum(F.col("is_lowest").cast("long"))
    cells = materialise(
        with_keys(flagged, "category").groupBy("store", "city", "category").agg(
            wins.alias("_wins"), F.count(F.lit(1)).alias("_rows")
        )
    )
    # Category sizes and the total weight are roll-ups of the same small table.
    cells = cells.withColumn("_size", F.sum("_rows").over(Window.partitionBy("category")))
    markets = with_keys(cells, "store", "city").groupBy("store", "city").agg(
        F.sum("_wins").alias("wins"),
        F.sum("_rows").alias("_rows"),
        F.sum(F.col("_wins") * F.col("_size")).alias("_weight"),
    )
    # Both totals are one row each; stacked and folded they are one row beside each market.
    totals = (
        cells.agg(F.sum("_rows").alias("_total"))
        .unionByName(flagged.agg(F.countDistinct("product_id").alias("_products")), allowMissingColumns=True)
        .agg(F.max("_total").alias("_total"), F.max("_products").alias("_products"), F.lit(1).alias("_one"))
    )
    none = F.lit(0.0)
    return markets.withColumn("_one", F.lit(1)).join(totals, "_one").select(
        "store",
        "city",
        F.coalesce(F.try_divide("wins", "_products"), none).alias("ldi"),
        F.coalesce(F.try_divide("_weight", "_total"), none).alias("weighted_ldi"),
        F.coalesce(F.try_divide("wins", "_rows"), none).alias("leadership_frequency"),
        "wins",
    )


def category_dominance(flagged: DataFrame) -> DataFrame:
    """Wins per distinct product of each category and store; several cities may push it over 1."""
    per_product = with_keys(flagged, "category", "store").groupBy("category", "store", "product_id").agg(
        F.sum(F.col("is_lowest").cast("long")).alias("_wins")
    )
    return per_product.groupBy("category", "store").agg(
        F.try_divide(F.sum("_wins"), F.count("product_id")).alias("cat_ldi")
    )


def store_scorecard(offers: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Price index, volatility, deviation and dominance of each store and city."""
    keys = ["store", "city"]
    flagged = flag_lowest_once(offers) if flagged is None else flagged
    return (
        store_price_index(flagged)
        .join(median_price_deviation(flagged), keys)
        .join(dominance_index(flagged), keys)
    )


def product_representative(offers: DataFrame) -> DataFrame:
    """Size, brand, category and city of the first row of each product."""
    first = Window.partitionBy("product_id").orderBy("ord")
    # A rank limit of one is applied before the shuffle, so a hot product sends
    # one row per task.
    return (
        with_keys(offers, "product_id")
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .select("product_id", "quantity", "brand", "category", "city")
    )


def product_profile(offers: DataFrame, dispersion: DataFrame | None = None) -> DataFrame:
    """Dispersion, representative and number of offers of each product."""
    dispersion = price_dispersion(offers) if dispersion is None else dispersion
    counts = with_keys(offers, "product_id").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("competitor_count")
    )
    return dispersion.join(product_representative(offers), "product_id").join(counts, "product_id")


def size_vs_dispersion(profile: DataFrame) -> DataFrame:
    return profile.agg(safe_corr(F.col("quantity"), F.col("cv")).alias("size_vs_dispersion"))


def competitors_vs_spread(profile: DataFrame) -> DataFrame:
    return profile.agg(
        safe_corr(F.col("competitor_count"), F.col("price_spread_ratio")).alias("competitors_vs_spread")
    )


def brand_tier(offers: DataFrame) -> DataFrame:
    """Mean and volatility of each brand in a category, and whether it is premium."""
    rows = offers.select("brand", "category", nan_to_null(F.col("unit_price")).alias("unit_price"))
    counted = materialise(
        with_keys(rows, "category", "unit_price").groupBy("category", "unit_price").count()
    )
    medians = group_quantiles(counted, ["category"], "unit_price", {"cat_median_unit_price": 0.5}, weight="count")
    brands = with_keys(rows, "brand", "category").groupBy("brand", "category").agg(
        F.avg("unit_price").alias("mean_unit_price"), F.stddev_samp("unit_price").alias("volatility")
    )
    return brands.join(medians, "category", "left").select(
        "brand",
        "category",
        "mean_unit_price",
        "cat_median_unit_price",
        F.coalesce(
            F.col("mean_unit_price") > F.col("cat_median_unit_price") * PREMIUM_FACTOR, F.lit(False)
        ).alias("is_premium"),
        "volatility",
    )


def brand_volatility(offers: DataFrame) -> DataFrame:
    """Sample deviation of unit prices of each brand in a category."""
    return with_keys(offers, "brand", "category").groupBy("brand", "category").agg(
        F.stddev_samp(nan_to_null(F.col("unit_price"))).alias("volatility")
    )


def tier_vs_volatility(tiers: DataFrame) -> DataFrame:
    return tiers.agg(
        safe_corr(F.col("is_premium").cast("int"), F.col("volatility")).alias("brand_tier_vs_volatility")
    )


def store_correlations(offers: DataFrame) -> DataFrame:
    """Correlation of the mean product prices of every two stores, both orders.

    A product is first reduced to one mean per store, so the pairs formed per
    product are bounded by the number of stores, never by its offers.
    """
    means = with_keys(offers, "product_id", "store").groupBy("product_id", "store").agg(
        F.avg(nan_to_null(F.col("price"))).alias("mean")
    )
    sold = (
        means.filter(F.col("mean").isNotNull())
        .groupBy("product_id")
        .agg(F.array_sort(F.collect_list(F.struct("store", "mean"))).alias("by_store"))
        .filter(F.size("by_store") >= 2)
    )
    pairs = sold.select(F.posexplode("by_store").alias("i", "a"), "by_store").select(
        "a", F.explode(F.expr("slice(by_store, i + 1, size(by_store))")).alias("b")
    )
    upper = pairs.groupBy(F.col("a.store").alias("store_a"), F.col("b.store").alias("store_b")).agg(
        safe_corr(F.col("a.mean"), F.col("b.mean")).alias("corr")
    )
    lower = F.struct(F.col("store_b").alias("store_a"), F.col("store_a").alias("store_b"), "corr")
    both = F.when(F.col("store_a") == F.col("store_b"), F.array(F.struct("store_a", "store_b", "corr"))).otherwise(
        F.array(F.struct("store_a", "store_b", "corr"), lower)
    )
    return upper.select(F.inline(both))


def price_sync_score(offers: DataFrame) -> DataFrame:
    """Mean over stores of their mean correlation; 0 when no product is in two stores."""
    columns = store_correlations(offers).groupBy("store_b").agg(F.avg("corr").alias("column_mean"))
    return columns.agg(
        F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(F.avg("column_mean")).alias("synchronization_score")
    )


def city_correlation(profile: DataFrame) -> DataFrame:
    """Correlation matrix of the product measures in each city, in long form.

    Undefined entries are 0, the diagonal of a constant measure included.
    """
    n = len(CITY_MEASURES)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    measures = [F.col(m) for m in CITY_MEASURES]
    # One aggregation with a column per pair: a product is one row throughout.
    wide = with_keys(profile, "city").groupBy("city").agg(
        *[F.coalesce(safe_corr(measures[i], measures[j]), F.lit(0.0)).alias(f"_{i}_{j}") for i, j in upper]
    )
    entries = [
        F.struct(F.lit(CITY_MEASURES[a]).alias("var_x"), F.lit(CITY_MEASURES[b]).alias("var_y"), F.col(f"_{i}_{j}").alias("corr"))
        for i, j in upper
        for a, b in dict.fromkeys([(i, j), (j, i)])
    ]
    return wide.select("city", F.inline(F.array(*entries)))


def top_categories(cat_ldi: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    """Categories of highest mean dominance; ties by name."""
    return (
        cat_ldi.groupBy("category")
        .agg(F.avg("cat_ldi").alias("cat_ldi"))
        .orderBy(F.desc("cat_ldi"), "category")
        .limit(n)
    )


def market_overview(offers: DataFrame) -> DataFrame:
    """Offer rows, products, brands and the synchronisation score in one row."""
    sizes = offers.agg(
        F.count(F.lit(1)).alias("offer_rows"),
        F.countDistinct("product_id").alias("products"),
        F.countDistinct("brand").alias("brands"),
    )
    # Two one-row results side by side: stack them and fold the rows into one.
    stacked = sizes.unionByName(price_sync_score(offers), allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
