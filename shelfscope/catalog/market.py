"""Queries over offers and gold products: statistics, dominance, correlations, exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.catalog.common import BEST, GOLD, OFFERS, long_form, long_sql, r, scratch, tidied, with_ctes
from shelfscope.operators import analytics as A
from shelfscope.operators import explore as X
from shelfscope.operators import report, search
from shelfscope.plans.views import gold_view, offers_view
from shelfscope.session import materialise

QUERIES, ORACLES = {}, {}

PERCENTILES = "quantile_cont({0}, 0.25) AS q1, quantile_cont({0}, 0.5) AS median, quantile_cont({0}, 0.75) AS q3"

# --- SQL of the metric tables, as common table expressions ---
DISPERSION = """
dispersion AS (
  SELECT product_id, avg(price) AS mean, quantile_cont(price, 0.5) AS median,
         coalesce(stddev_samp(price), 0) AS std, min(price) AS "min", max(price) AS "max",
         quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr,
         coalesce(stddev_samp(price), 0) / nullif(avg(price), 0) AS cv,
         max(price) - min(price) AS price_range, max(price) / nullif(min(price), 0) AS price_spread_ratio
  FROM offers GROUP BY product_id
)"""
POSITION = """
position AS (
  SELECT offers.*, local_cat_mean, global_cat_mean,
         unit_price / local_cat_mean AS relative_price_position,
         unit_price / global_cat_mean AS global_relative_position
  FROM offers
  JOIN (SELECT city, category, avg(unit_price) AS local_cat_mean FROM offers GROUP BY ALL) USING (city, category)
  JOIN (SELECT category, avg(unit_price) AS global_cat_mean FROM offers GROUP BY ALL) USING (category)
)"""
FLAGGED = """
flagged AS (
  SELECT *, coalesce(price = min(price) OVER (PARTITION BY product_id), false) AS is_lowest,
         count(*) OVER (PARTITION BY category) AS cat_size
  FROM offers
)"""
DOMINANCE = """
dominance AS (
  SELECT store, city,
         sum(CAST(is_lowest AS INT)) / (SELECT count(DISTINCT product_id) FROM offers) AS ldi,
         sum(CASE WHEN is_lowest THEN cat_size ELSE 0 END) / (SELECT count(*) FROM offers) AS weighted_ldi,
         sum(CAST(is_lowest AS INT)) / count(*) AS leadership_frequency,
         CAST(sum(CAST(is_lowest AS INT)) AS BIGINT) AS wins
  FROM flagged GROUP BY store, city
)"""
INDEX = """
price_index AS (
  SELECT store, city, avg(relative_price_position) AS avg_category_price_index,
         stddev_samp(price) AS price_volatility_score
  FROM position GROUP BY store, city
)"""
DEVIATION = """
deviation AS (
  SELECT store, city, mad(price) AS median_price_deviation FROM offers GROUP BY store, city
)"""
SCORECARD = ",".join([POSITION, FLAGGED, DOMINANCE, INDEX, DEVIATION]) + """,
scorecard AS (
  SELECT * FROM price_index JOIN deviation USING (store, city) JOIN dominance USING (store, city)
)"""
CAT_LDI = """
cat_ldi AS (
  SELECT category, store, sum(CAST(is_lowest AS INT)) / count(DISTINCT product_id) AS cat_ldi
  FROM flagged GROUP BY category, store
)"""
FIRST_ROWS = """
first_rows AS (
  SELECT product_id, quantity, brand, category, city FROM offers
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ord) = 1
)"""
PROFILE = DISPERSION + "," + FIRST_ROWS + """,
profile AS (
  SELECT d.*, f.quantity, f.brand, f.category, f.city, c.competitor_count
  FROM dispersion d JOIN first_rows f USING (product_id)
  JOIN (SELECT product_id, count(*) AS competitor_count FROM offers GROUP BY product_id) c USING (product_id)
)"""
TIERS = f"""
tiers AS (
  SELECT brand, category, avg(unit_price) AS mean_unit_price, any_value(med) AS cat_median_unit_price,
         avg(unit_price) > any_value(med) * {A.PREMIUM_FACTOR} AS is_premium,
         stddev_samp(unit_price) AS volatility
  FROM offers JOIN (SELECT category, median(unit_price) AS med FROM offers GROUP BY category) USING (category)
  GROUP BY brand, category
)"""
STORE_PAIRS = """
store_means AS (SELECT product_id, store, avg(price) AS m FROM offers GROUP BY product_id, store),
several AS (SELECT product_id FROM store_means GROUP BY product_id HAVING count(*) >= 2),
store_pairs AS (
  SELECT a.store AS store_a, b.store AS store_b,
         covar_pop(a.m, b.m) / nullif(stddev_pop(a.m) * stddev_pop(b.m), 0) AS corr
  FROM store_means a JOIN several USING (product_id) JOIN store_means b ON a.product_id = b.product_id
  GROUP BY a.store, b.store
),
sync AS (
  SELECT coalesce(avg(cm), 0) AS synchronization_score
  FROM (SELECT store_b, avg(corr) AS cm FROM store_pairs GROUP BY store_b)
)"""


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


_MEASURES = ", ".join(f"{{'v': '{m}', 'x': CAST(\"{m}\" AS DOUBLE)}}" for m in A.CITY_MEASURES)
CITY_MATRIX = f"""
melted AS (SELECT product_id, city, unnest([{_MEASURES}], recursive := true) FROM profile),
city_matrix AS (
  SELECT a.city AS city, a.v AS var_x, b.v AS var_y, coalesce({corr("a.x", "b.x")}, 0) AS corr
  FROM melted a JOIN melted b USING (product_id) GROUP BY a.city, a.v, b.v
)"""


def query(sql: str | None):
    """Register a function of (spark, folder) under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: tidied(f(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(table: str, keys: str, values: list[str], *ctes: str) -> str:
    cols = ", ".join(f'{r(chr(34) + v + chr(34))} AS "{v}"' for v in values)
    return with_ctes(*ctes, select=f"SELECT {keys}{', ' if keys and cols else ''}{cols} FROM {table}")


def _offers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The offers, written once, for queries that read them more than once."""
    offers = offers_view(spark, folder)
    return materialise(offers.select(*columns) if columns else offers)


_FLAGGABLE = [c for c in A.FLAGGED if c != "is_lowest"]


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return A.product_profile(_offers(spark, folder, "product_id", "price", "quantity", "brand", "category", "city", "ord"))


_DISPERSION_COLUMNS = ["mean", "median", "std", "min", "max", "iqr", "cv", "price_range", "price_spread_ratio"]


# --- statistics over offers ---


@query(
    with_ctes(
        OFFERS,
        GOLD,
        select=f"""SELECT product_id, title, brand, quantity, unit, category, o.store AS store, o.city AS city,
                   o.price AS price, o.unit_price AS unit_price
                   FROM (SELECT *, unnest(offers) AS o FROM gold)""",
    )
)
def explode_offers(spark, folder):
    return A.explode_offers(gold_view(spark, folder)).drop("offer_pos")


# Gold whose offers in one store have no prices: they are no offers at 0 and win nothing.
_PRICELESS = "ASIA"
_PRICELESS_SQL = (
    OFFERS,
    GOLD,
    f"""
unpriced AS (
  SELECT product_id, title, category, o.store AS store, o.city AS city,
         CASE WHEN o.store <> '{_PRICELESS}' THEN o.price END AS price,
         CASE WHEN o.store <> '{_PRICELESS}' THEN o.unit_price END AS unit_price
  FROM (SELECT *, unnest(offers) AS o FROM gold)
)""",
    FLAGGED.replace("FROM offers", "FROM unpriced"),
)


def _priceless(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """These offers, written once: flagging the lowest reads them twice."""

    def offer(o):
        price = {name: F.when(o["store"] != _PRICELESS, o[name]) for name in ("price", "unit_price")}
        return F.struct(*[price.get(name, o[name]).alias(name) for name in ("store", "city", "price", "unit_price", "timestamp")])

    offers = A.explode_offers(gold_view(spark, folder).withColumn("offers", F.transform("offers", offer)))
    return materialise(offers.select(*columns))


@query(with_ctes(*_PRICELESS_SQL, select="SELECT product_id, title, store, city, price, unit_price, is_lowest FROM flagged"))
def is_lowest_without_prices(spark, folder):
    columns = ["product_id", "title", "store", "city", "price", "unit_price"]
    return A.is_lowest(_priceless(spark, folder, *columns)).select(*columns, "is_lowest")


@query(
    rounded(
        "dominance",
        "store, city, wins",
        ["ldi", "weighted_ldi", "leadership_frequency"],
        *_PRICELESS_SQL,
        DOMINANCE.replace("FROM offers", "FROM unpriced"),
    )
)
def dominance_without_prices(spark, folder):
    return A.dominance_index(A.flag_lowest_once(_priceless(spark, folder, *_FLAGGABLE)))


@query(rounded("dispersion", "product_id", _DISPERSION_COLUMNS, OFFERS, DISPERSION))
def price_dispersion(spark, folder):
    return A.price_dispersion(_offers(spark, folder, "product_id", "price"))


@query(
    rounded(
        "position",
        "l_orderkey, l_linenumber, product_id, store, city, category, price, unit_price",
        ["relative_price_position", "global_relative_position"],
        OFFERS,
        POSITION,
    )
)
def relative_position(spark, folder):
    return A.relative_position(offers_view(spark, folder)).select(
        "ord.l_orderkey",
        "ord.l_linenumber",
        "product_id",
        "store",
        "city",
        "category",
        "price",
        "unit_price",
        "relative_price_position",
        "global_relative_position",
    )


@query(rounded("price_index", "store, city", ["avg_category_price_index", "price_volatility_score"], OFFERS, POSITION, INDEX))
def store_price_index(spark, folder):
    return A.store_price_index(offers_view(spark, folder))


@query(rounded("deviation", "store, city", ["median_price_deviation"], OFFERS, DEVIATION))
def median_price_deviation(spark, folder):
    return A.median_price_deviation(offers_view(spark, folder))


@query(
    with_ctes(
        OFFERS,
        FLAGGED,
        select="SELECT l_orderkey, l_linenumber, product_id, store, city, price, is_lowest FROM flagged",
    )
)
def is_lowest(spark, folder):
    return A.is_lowest(offers_view(spark, folder)).select(
        "ord.l_orderkey", "ord.l_linenumber", "product_id", "store", "city", "price", "is_lowest"
    )


@query("SELECT p_type AS category, count(*) AS cat_size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def category_size(spark, folder):
    return A.category_size(offers_view(spark, folder))


_LDI = ["ldi", "weighted_ldi", "leadership_frequency"]
_SCORE = ["avg_category_price_index", "price_volatility_score", "median_price_deviation", *_LDI]


METRICS_IN_LONG_FORM = " UNION ALL ".join(
    [
        long_sql("product_dispersion_metrics", "dispersion", ["product_id"], _DISPERSION_COLUMNS),
        long_sql("store_market_metrics", "scorecard", ["store", "city"], [*_SCORE, "wins"]),
        long_sql("category_ldi_stats", "cat_ldi", ["category", "store"], ["cat_ldi"]),
    ]
)


def metrics_in_long_form(tables: dict[str, DataFrame]) -> DataFrame:
    return long_form(
        {
            "product_dispersion_metrics": (tables["product_dispersion_metrics"], ["product_id"]),
            "store_market_metrics": (tables["store_market_metrics"], ["store", "city"]),
            "category_ldi_stats": (tables["category_ldi_stats"], ["category", "store"]),
        }
    )


@query(rounded("dominance", "store, city, wins", _LDI, OFFERS, FLAGGED, DOMINANCE))
def dominance_index(spark, folder):
    return A.dominance_index(A.flag_lowest_once(_offers(spark, folder, *_FLAGGABLE)))


@query(rounded("cat_ldi", "category, store", ["cat_ldi"], OFFERS, FLAGGED, CAT_LDI))
def category_dominance(spark, folder):
    return A.category_dominance(A.is_lowest(_offers(spark, folder, *_FLAGGABLE)))


@query(rounded("scorecard", "store, city, wins", _SCORE, OFFERS, SCORECARD))
def store_scorecard(spark, folder):
    return A.store_scorecard(_offers(spark, folder, *_FLAGGABLE))


@query(with_ctes(OFFERS, FIRST_ROWS, select="SELECT * FROM first_rows"))
def product_representative(spark, folder):
    return A.product_representative(offers_view(spark, folder))


@query(
    with_ctes(
        OFFERS, PROFILE, select=f"SELECT {r(corr('quantity', 'cv'))} AS size_vs_dispersion FROM profile"
    )
)
def size_vs_dispersion(spark, folder):
    return A.size_vs_dispersion(_profile(spark, folder))


@query(
    with_ctes(
        OFFERS,
        PROFILE,
        select=f"""SELECT {r(corr('CAST(competitor_count AS DOUBLE)', 'price_spread_ratio'))}
                   AS competitors_vs_spread FROM profile""",
    )
)
def competitors_vs_spread(spark, folder):
    return A.competitors_vs_spread(_profile(spark, folder))


@query(
    rounded(
        "tiers", "brand, category, is_premium", ["mean_unit_price", "cat_median_unit_price", "volatility"], OFFERS, TIERS
    )
)
def brand_tier(spark, folder):
    return A.brand_tier(_offers(spark, folder, "brand", "category", "unit_price"))


@query(rounded("tiers", "brand, category", ["volatility"], OFFERS, TIERS))
def brand_volatility(spark, folder):
    return A.brand_volatility(offers_view(spark, folder))


@query(
    with_ctes(
        OFFERS,
        TIERS,
        select=f"""SELECT {r(corr('CAST(is_premium AS INT)', 'volatility'))} AS brand_tier_vs_volatility
                   FROM tiers WHERE volatility IS NOT NULL""",
    )
)
def tier_vs_volatility(spark, folder):
    return A.tier_vs_volatility(A.brand_tier(_offers(spark, folder, "brand", "category", "unit_price")))


@query(rounded("store_pairs", "store_a, store_b", ["corr"], OFFERS, STORE_PAIRS))
def store_correlations(spark, folder):
    return A.store_correlations(offers_view(spark, folder))


@query(rounded("sync", "", ["synchronization_score"], OFFERS, STORE_PAIRS))
def price_sync_score(spark, folder):
    return A.price_sync_score(offers_view(spark, folder))


@query(rounded("city_matrix", "city, var_x, var_y", ["corr"], OFFERS, PROFILE, CITY_MATRIX))
def city_correlation(spark, folder):
    return A.city_correlation(_profile(spark, folder))


TOP = """
top AS (
  SELECT category, avg(cat_ldi) AS cat_ldi FROM cat_ldi GROUP BY category ORDER BY 2 DESC, 1 LIMIT 10
)"""


@query(rounded("top", "category", ["cat_ldi"], OFFERS, FLAGGED, CAT_LDI, TOP))
def top_categories(spark, folder):
    return A.top_categories(A.category_dominance(A.is_lowest(_offers(spark, folder, *_FLAGGABLE))))


OVERVIEW = """
overview AS (
  SELECT count(*) AS offer_rows, count(DISTINCT product_id) AS products, count(DISTINCT brand) AS brands,
         (SELECT synchronization_score FROM sync) AS synchronization_score
  FROM offers
)"""


@query(rounded("overview", "offer_rows, products, brands", ["synchronization_score"], OFFERS, STORE_PAIRS, OVERVIEW))
def market_overview(spark, folder):
    return A.market_overview(_offers(spark, folder, "product_id", "brand", "store", "price"))


def _melt(table: str, section: str, key: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS key, '{m}' AS metric, {r(f'CAST({m} AS DOUBLE)')} AS value FROM {table}"
        for m in metrics
    )


REPORT_SECTIONS = " UNION ALL ".join(
    [
        _melt("overview", "overview", "'market'", ["offer_rows", "products", "brands", "synchronization_score"]),
        _melt("scorecard", "scorecard", "store || ' / ' || city", report.SCORECARD_METRICS),
        f"SELECT 'correlation', 'market', 'size_vs_dispersion', {r(corr('quantity', 'cv'))} FROM profile",
        f"""SELECT 'correlation', 'market', 'competitors_vs_spread',
            {r(corr('CAST(competitor_count AS DOUBLE)', 'price_spread_ratio'))} FROM profile""",
        f"""SELECT 'correlation', 'market', 'brand_tier_vs_volatility',
            {r(corr('CAST(is_premium AS INT)', 'volatility'))} FROM tiers WHERE volatility IS NOT NULL""",
        f"""SELECT 'city_matrix', city, var_x || ' ~ ' || var_y, {r('corr')} FROM city_matrix
            WHERE var_x IN ('mean', 'std', 'cv') AND var_y IN ('mean', 'std', 'cv')""",
        _melt("top", "top_categories", "category", ["cat_ldi"]),
    ]
)


@query(
    with_ctes(
        OFFERS, PROFILE, CITY_MATRIX, SCORECARD, CAT_LDI, TOP, TIERS, STORE_PAIRS, OVERVIEW, select=REPORT_SECTIONS
    )
)
def report_tables(spark, folder):
    offers = _offers(spark, folder, *_FLAGGABLE, "brand", "quantity", "ord")
    flagged = A.flag_lowest_once(offers)
    profile = materialise(A.product_profile(offers))
    correlations = [
        A.size_vs_dispersion(profile),
        A.competitors_vs_spread(profile),
        A.tier_vs_volatility(A.brand_tier(offers)),
    ]
    return report.report_tables(
        A.market_overview(offers),
        A.store_scorecard(offers, flagged),
        correlations,
        A.city_correlation(profile),
        A.category_dominance(flagged),
    )


# --- exploration over gold ---

CITIES = ["NATION_1", "NATION_7", "NATION_12"]
CATEGORIES = ["ECONOMY", "LARGE", "PROMO"]
_IN_CITIES = "list_has_any(list_transform(offers, lambda o: o.city), ['NATION_1', 'NATION_7', 'NATION_12'])"
_IN_CATEGORIES = "category IN ('ECONOMY', 'LARGE', 'PROMO')"
PRICES = f"prices AS (SELECT category, offers[1].city AS city, min_price AS p FROM gold WHERE {_IN_CATEGORIES})"


@query(
    with_ctes(
        OFFERS,
        "kinds AS (SELECT DISTINCT category FROM offers)",
        select="""SELECT 'city' AS filter, city AS value, true AS selected FROM (SELECT DISTINCT city FROM offers)
                  UNION ALL
                  SELECT 'category', category, row_number() OVER (ORDER BY category) <= 5 FROM kinds""",
    )
)
def filter_values(spark, folder):
    return X.filter_values(gold_view(spark, folder))


def _kpi_sql(where: str) -> str:
    spread = "sum(CASE WHEN min_price > 0 THEN (max_price - min_price) / min_price END) / count(*)"
    return with_ctes(
        OFFERS,
        GOLD,
        select=f"""SELECT count(*) AS products, count(DISTINCT brand) AS brands,
                   CAST(sum(CAST(len(offers) > 1 AS INT)) AS BIGINT) AS matched_products,
                   {r("sum(CAST(len(offers) > 1 AS INT)) * 100.0 / count(*)")} AS match_rate,
                   {r(spread)} AS avg_spread FROM gold WHERE {where}""",
    )


@query(_kpi_sql("true"))
def kpis(spark, folder):
    return X.kpis(gold_view(spark, folder))


@query(_kpi_sql(_IN_CITIES))
def kpis_in_region(spark, folder):
    return X.kpis(gold_view(spark, folder), CITIES)


@query(with_ctes(OFFERS, GOLD, select=f"SELECT product_id, title, match_count FROM gold WHERE {_IN_CITIES}"))
def region_filter(spark, folder):
    return X.region_filter(gold_view(spark, folder), CITIES).select("product_id", "title", "match_count")


@query(rounded("scorecard", "store, city, wins", _SCORE, OFFERS, SCORECARD) + " ORDER BY scorecard.ldi DESC, store, city")
def dominance_ranking(spark, folder):
    return X.dominance_ranking(A.store_scorecard(_offers(spark, folder, *_FLAGGABLE)))


_IN_CITIES_ROWS = f"city IN ({', '.join(repr(c) for c in CITIES)})"


@query(
    rounded("(SELECT * FROM scorecard WHERE " + _IN_CITIES_ROWS + ")", "store, city, wins", _SCORE, OFFERS, SCORECARD)
    + " ORDER BY ldi DESC, store, city"
)
def dominance_ranking_in_region(spark, folder):
    return X.dominance_ranking(A.store_scorecard(_offers(spark, folder, *_FLAGGABLE)), CITIES)


@query(
    with_ctes(
        OFFERS,
        BEST,
        select=f"""SELECT store, count(*) AS offers, {r("count(*) / sum(count(*)) OVER ()")} AS share
                   FROM best GROUP BY store ORDER BY 2 DESC, 1""",
    )
)
def market_share(spark, folder):
    return X.market_share(gold_view(spark, folder))


@query(
    rounded(
        "boxes",
        "category, city, products",
        ["min", "q1", "median", "q3", "max"],
        OFFERS,
        GOLD,
        PRICES,
        f"""boxes AS (SELECT category, city, count(*) AS products, min(p) AS "min", {PERCENTILES.format('p')},
            max(p) AS "max" FROM prices GROUP BY category, city)""",
    )
)
def category_price_distribution(spark, folder):
    return X.category_price_distribution(gold_view(spark, folder), CATEGORIES)


@query(
    with_ctes(
        OFFERS,
        GOLD,
        PRICES,
        select=f"""SELECT category, {r("stddev_samp(p)")} AS price_volatility FROM prices
                   GROUP BY category ORDER BY 2 DESC, 1""",
    )
)
def category_volatility(spark, folder):
    return X.category_volatility(gold_view(spark, folder), CATEGORIES)


@query(
    with_ctes(
        OFFERS,
        GOLD,
        select="""SELECT product_id, title, brand, min_price, max_price, match_count FROM gold
                  WHERE contains(lower(title), 'anvil') OR contains(lower(brand), 'anvil')
                  ORDER BY product_id LIMIT 15""",
    )
)
def product_search(spark, folder):
    return X.product_search(gold_view(spark, folder), "Anvil").select(
        "product_id", "title", "brand", "min_price", "max_price", "match_count"
    )


@query(
    with_ctes(
        OFFERS,
        GOLD,
        select="""SELECT CAST(product_id AS VARCHAR) AS product_id, title, brand, min_price, max_price, match_count FROM gold
                  WHERE contains(lower(title), 'hot anvil') OR contains(lower(brand), 'hot anvil')
                  ORDER BY 1 LIMIT 15""",
    )
)
def indexed_search(spark, folder):
    """The search over products that were landed with their index."""
    path = scratch(spark)
    search.write_index(gold_view(spark, folder).withColumn("product_id", F.col("product_id").cast("string")), path)
    return search.indexed_search(spark, path, "Hot Anvil").select(
        "product_id", "title", "brand", "min_price", "max_price", "match_count"
    )


@query(
    with_ctes(
        OFFERS,
        BEST,
        select="""SELECT product_id, p_name AS title, store, city, o.price AS price,
                  CAST(row_number() OVER (PARTITION BY product_id ORDER BY o.price, first_ord) AS INT) AS rank,
                  o.price = min(o.price) OVER (PARTITION BY product_id) AS is_cheapest
                  FROM best JOIN part ON product_id = p_partkey""",
    )
)
def ranked_offers(spark, folder):
    return X.ranked_offers(gold_view(spark, folder))


# --- the unfiltered defaults, and a choice of cities ---

_ALL_PRICES = """
prices AS (SELECT category, offers[1].city AS city, min_price AS p FROM gold)"""
_REGION_PRICES = _ALL_PRICES.replace("FROM gold", f"FROM gold WHERE {_IN_CITIES}")


def _boxes(prices: str) -> str:
    return rounded(
        "boxes",
        "category, city, products",
        ["min", "q1", "median", "q3", "max"],
        OFFERS,
        GOLD,
        prices,
        f"""boxes AS (SELECT category, city, count(*) AS products, min(p) AS "min", {PERCENTILES.format('p')},
            max(p) AS "max" FROM prices GROUP BY category, city)""",
    )


def _volatility(prices: str) -> str:
    return with_ctes(
        OFFERS, GOLD, prices, select=f"SELECT category, {r('stddev_samp(p)')} AS price_volatility FROM prices GROUP BY category"
    )


@query(_boxes(_ALL_PRICES))
def category_price_distribution_of_all(spark, folder):
    return X.category_price_distribution(gold_view(spark, folder))


@query(_boxes(_REGION_PRICES))
def category_price_distribution_in_region(spark, folder):
    return X.category_price_distribution(gold_view(spark, folder), cities=CITIES)


@query(_volatility(_ALL_PRICES))
def category_volatility_of_all(spark, folder):
    return X.category_volatility(gold_view(spark, folder))


@query(_volatility(_REGION_PRICES))
def category_volatility_in_region(spark, folder):
    return X.category_volatility(gold_view(spark, folder), cities=CITIES)


@query(
    with_ctes(
        OFFERS,
        BEST,
        select=f"""SELECT store, count(*) AS offers, {r("count(*) / sum(count(*)) OVER ()")} AS share
                   FROM best WHERE {_IN_CITIES_ROWS} GROUP BY store""",
    )
)
def market_share_in_region(spark, folder):
    return X.market_share(gold_view(spark, folder), CITIES)


@query(
    with_ctes(
        OFFERS,
        GOLD,
        select=f"""SELECT product_id, title, min_price FROM gold
                   WHERE (contains(lower(title), 'anvil') OR contains(lower(brand), 'anvil')) AND {_IN_CITIES}
                   ORDER BY product_id LIMIT 15""",
    )
)
def product_search_in_region(spark, folder):
    return X.product_search(gold_view(spark, folder), "Anvil", cities=CITIES).select("product_id", "title", "min_price")


@query(
    with_ctes(
        OFFERS,
        BEST,
        select=f"""SELECT product_id, store, city, o.price AS price,
                   CAST(row_number() OVER (PARTITION BY product_id ORDER BY o.price, first_ord) AS INT) AS rank
                   FROM best WHERE product_id IN (SELECT product_id FROM best WHERE {_IN_CITIES_ROWS})""",
    )
)
def ranked_offers_in_region(spark, folder):
    return X.ranked_offers(gold_view(spark, folder), CITIES).select("product_id", "store", "city", "price", "rank")
