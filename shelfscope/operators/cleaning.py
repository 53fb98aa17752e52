"""Raw listings to cleaned listings: parsing, required fields, sanity, outliers, copies.

``file_name`` names the feed a row came from and ``row_pos`` its place in it;
copies and outliers are judged per feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import text
from shelfscope.functions.stats import attach, group_quantiles
from shelfscope.schemas import CLEANED_FIELDS
from shelfscope.session import materialise

# --- Fixed values: bounds of the row filters ---
UNIT_PRICE_ABOVE, UNIT_PRICE_BELOW = 1.0, 100000.0
FEWEST_PRICES = 5  # categories with fewer prices are kept whole
MOST_DEVIATIONS = 5.0
FENCE = 2.5  # multiples of the interquartile range
# --- end of fixed values ---

FEED = "file_name"
POSITION = "row_pos"


def dedup_first(raw: DataFrame) -> DataFrame:
    """First row of each (name, raw price, store, city) of a feed."""
    # Spark moves filters on columns a window is partitioned by in front of it.
    # Under its own name the price would take its parsing along, for every copy.
    # The hash decides most comparisons of the sort.
    keys = {"_copy_hash": F.xxhash64(FEED, "name", "price", "store", "city"), "_copy_price": F.col("price")}
    copies = Window.partitionBy(*keys, FEED, "name", "store", "city").orderBy(POSITION)
    # The rank limit of one is applied before the shuffle, so a listing that
    # fills a third of the feed sends one row per task.
    ranked = raw.withColumns(keys).withColumn("_copy", F.row_number().over(copies))
    return ranked.filter(F.col("_copy") == 1).drop("_copy", *keys)


def normalize_listing(raw: DataFrame) -> DataFrame:
    """Typed price, quantity, unit, unit price and brand; defaults for missing fields."""
    name = F.coalesce("name", F.lit(""))
    price = text.price_or_name_price(F.col("price"), name)
    quantity = text.quantity_value(name)
    columns = {
        "product_id": F.coalesce("product_id", F.lit("")),
        "name": name,
        "brand": text.resolve_brand(F.coalesce("brand", F.lit(text.DEFAULT_BRAND)), name),
        "category": F.coalesce("category", F.lit("")),
        "subcategory": F.coalesce("subcategory", F.lit("")),
        "price": price,
        "quantity": quantity,
        "unit": text.quantity_unit(name),
        "unit_price": text.unit_price(price, quantity),
        "availability": F.coalesce("availability", F.lit("In Stock")),
        "store": F.coalesce("store", F.lit("")),
        "city": F.coalesce("city", F.lit("")),
        "product_url": F.coalesce("product_url", F.lit("")),
        "image_url": F.coalesce("image_url", F.lit("")),
        "scrape_timestamp": F.col("timestamp").try_cast("timestamp"),
        "processed_timestamp": F.current_timestamp(),
    }
    kept = [c for c in (FEED, POSITION) if c in raw.columns]
    return raw.select(*kept, *[columns[c].alias(c) for c in CLEANED_FIELDS])


def require_fields(cleaned: DataFrame) -> DataFrame:
    """Rows with a name, a store and a price other than 0."""
    return cleaned.filter((F.col("name") != "") & (F.col("store") != "") & (F.col("price") != 0))


def sane_unit_price(cleaned: DataFrame) -> DataFrame:
    """Rows with a unit price strictly inside the accepted range."""
    return cleaned.filter(
        (F.col("unit_price") > UNIT_PRICE_ABOVE) & (F.col("unit_price") < UNIT_PRICE_BELOW)
    )


def _judged(cleaned: DataFrame) -> DataFrame:
    """Rows with their category's price statistics and the reason to reject them, if any."""
    keys = [FEED, "category"]
    # A category may be most of a feed: its statistics come from its distinct
    # prices with their counts, folded before the shuffle.
    counted = materialise(
        cleaned.filter(F.col("price").isNotNull()).groupBy(*keys, "price").agg(F.count(F.lit(1)).alias("_copies"))
    )
    copies, price = F.col("_copies"), F.col("price")
    fences = group_quantiles(
        counted,
        keys,
        "price",
        {"q1": 0.25, "q3": 0.75},
        weight="_copies",
        moments={"n": F.sum(copies), "mean": F.sum(price * copies) / F.sum(copies)},
    )
    fences = materialise(fences)
    spread = (
        counted.join(fences.select(*keys, "n", "mean"), keys)
        .groupBy(*keys)
        .agg(F.sqrt(F.sum(copies * (price - F.col("mean")) ** 2) / F.first("n")).alias("std"))
    )
    iqr = F.col("q3") - F.col("q1")
    bounds = fences.join(spread, keys).select(
        *keys,
        "n",
        "mean",
        "std",
        (F.col("q1") - FENCE * iqr).alias("lower"),
        (F.col("q3") + FENCE * iqr).alias("upper"),
    )
    z = F.when(F.col("std") > 0, F.abs((price - F.col("mean")) / F.col("std"))).otherwise(F.lit(0.0))
    reason = (
        F.when(F.col("n") < FEWEST_PRICES, F.lit(None))
        .when(z > MOST_DEVIATIONS, F.lit("z-score"))
        .when((price < F.col("lower")) | (price > F.col("upper")), F.lit("iqr"))
    )
    return attach(cleaned, bounds, keys).withColumn("reason", reason)


def category_outlier_filter(cleaned: DataFrame) -> DataFrame:
    """Drop prices far outside their category in the same feed."""
    return _judged(cleaned).filter(F.col("reason").isNull()).select(*cleaned.columns)


def outlier_audit(cleaned: DataFrame) -> DataFrame:
    """The rows :func:`category_outlier_filter` drops, with the reason and the bounds."""
    return _judged(cleaned).filter(F.col("reason").isNotNull()).select(
        *cleaned.columns, "reason", "mean", "std", "lower", "upper"
    )


def clean_listings(raw: DataFrame) -> DataFrame:
    """Raw listings to cleaned ones: copies, parsing, required fields, sanity, outliers."""
    parsed = sane_unit_price(require_fields(normalize_listing(dedup_first(raw))))
    return category_outlier_filter(materialise(parsed))
