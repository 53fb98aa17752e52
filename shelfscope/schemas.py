"""Explicit schemas of the data model; nothing is ever inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_FIELDS = [
    "store",
    "city",
    "product_id",
    "name",
    "brand",
    "category",
    "subcategory",
    "price",
    "availability",
    "product_url",
    "image_url",
    "timestamp",
]

RAW_LISTING = T.StructType([T.StructField(name, T.StringType()) for name in RAW_FIELDS])

CLEANED_FIELDS = [
    "product_id",
    "name",
    "brand",
    "category",
    "subcategory",
    "price",
    "quantity",
    "unit",
    "unit_price",
    "availability",
    "store",
    "city",
    "product_url",
    "image_url",
    "scrape_timestamp",
    "processed_timestamp",
]
CLEANED_NUMBERS = ["price", "quantity", "unit_price"]
CLEANED_TIMES = ["scrape_timestamp", "processed_timestamp"]


def _cleaned_type(name: str) -> T.DataType:
    return T.DoubleType() if name in CLEANED_NUMBERS else T.TimestampType() if name in CLEANED_TIMES else T.StringType()


# As we land it: typed, with the feed and the place in it.
LANDED_CLEANED = T.StructType(
    [T.StructField(name, _cleaned_type(name)) for name in CLEANED_FIELDS]
    + [T.StructField(name, T.StringType()) for name in ("file_name", "row_pos")]
)

# The older cleaned form: `title` for the name, JSON lines, 11 fields.
LEGACY_CLEANED = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("brand", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in CLEANED_NUMBERS[:2]]
    + [T.StructField("unit", T.StringType()), T.StructField("unit_price", T.DoubleType())]
    + [T.StructField(name, T.StringType()) for name in ("store", "city", "category", *CLEANED_TIMES)]
)

OFFER = T.StructType(
    [
        T.StructField("store", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

GOLD = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("offers", T.ArrayType(OFFER)),
        T.StructField("min_price", T.DoubleType()),
        T.StructField("max_price", T.DoubleType()),
        T.StructField("match_count", T.LongType()),
        T.StructField("cluster_size", T.LongType()),
        T.StructField("processed_at", T.StringType()),
    ]
)
GOLD_FLAT = [
    "product_id",
    "title",
    "brand",
    "quantity",
    "unit",
    "category",
    "min_price",
    "max_price",
    "match_count",
]

STORE_METRICS = T.StructType(
    [T.StructField("store", T.StringType()), T.StructField("city", T.StringType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in (
            "avg_category_price_index",
            "price_volatility_score",
            "median_price_deviation",
            "ldi",
            "weighted_ldi",
            "leadership_frequency",
        )
    ]
    + [T.StructField("wins", T.LongType())]
)
