"""Static dimensions of the sources: stores, their cities and category pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: markets and category pages ---
MARKETS = [
    ("Metro", "Karachi"),
    ("Metro", "Lahore"),
    ("Imtiaz", "Karachi"),
    ("Imtiaz", "Islamabad"),
    ("AlFatah", "Lahore"),
    ("AlFatah", "Faisalabad"),
]
CATEGORY_PAGES = [
    ("Metro", "Grocery", "https://www.metro-online.pk/grocery"),
    ("Metro", "Fruits-Vegetables", "https://www.metro-online.pk/fruits-and-vegetables"),
    ("Metro", "Meat-Poultry", "https://www.metro-online.pk/fresh-meat"),
    ("Metro", "Dairy-Frozen", "https://www.metro-online.pk/dairy-and-frozen-food"),
    ("Metro", "Beverages", "https://www.metro-online.pk/beverages"),
    ("Metro", "Household-Cleaning", "https://www.metro-online.pk/household-cleaning"),
    ("Metro", "Personal-Care", "https://www.metro-online.pk/personal-care"),
    ("Metro", "Electronics", "https://www.metro-online.pk/electronics-and-appliances"),
    ("Metro", "Baby-Care", "https://www.metro-online.pk/baby-care"),
    ("AlFatah", "Grocery-Foods", "https://alfatah.pk/collections/grocery-foods"),
    ("AlFatah", "Electronics", "https://alfatah.pk/collections/electronics"),
    ("AlFatah", "Perfumes", "https://alfatah.pk/collections/perfumes"),
    ("AlFatah", "Makeup", "https://alfatah.pk/collections/makeup"),
    ("AlFatah", "Skin-Care", "https://alfatah.pk/collections/skin-care"),
    ("AlFatah", "Baby-Care", "https://alfatah.pk/collections/baby-care"),
    ("AlFatah", "Household-Items", "https://alfatah.pk/collections/household-items"),
    ("AlFatah", "Beverages", "https://alfatah.pk/collections/drinks-beverages"),
]
# --- end of fixed values ---


def markets(spark: SparkSession) -> DataFrame:
    """(store, city) of every source."""
    return spark.createDataFrame(MARKETS, "store string, city string")


def category_pages(spark: SparkSession) -> DataFrame:
    """(store, category, url) of the sources with a fixed category list."""
    return spark.createDataFrame(CATEGORY_PAGES, "store string, category string, url string")


def source_catalogue(spark: SparkSession) -> DataFrame:
    """(store, city, category, url): what is collected where."""
    return markets(spark).join(category_pages(spark), "store", "left")
