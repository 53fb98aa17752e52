"""The stage jobs: clean, match, analyse, and the three in a row.

Each function takes and returns tables.  Within one session the stages pass
tables, not files; the writers in ``shelfscope.sources`` land them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators import analytics, cleaning, matching, report, search
from shelfscope.session import intermediates, materialise
from shelfscope.sources import gold as gold_io
from shelfscope.sources import listings as listing_io


def clean_listings(raw: DataFrame) -> DataFrame:
    """Copies, parsing, required fields, sanity and outliers, feed by feed.

    Unreadable values become NULL and drop their row only, so one bad feed
    never stops the others.
    """
    return cleaning.clean_listings(raw)


def match_listings(
    cleaned: DataFrame, threshold: int = matching.THRESHOLD, method: str = "token_sort"
) -> DataFrame:
    """Cleaned listings to gold products."""
    if "ord" not in cleaned.columns:
        cleaned = listing_io.arrival_order(cleaned)
    return matching.resolve_entities(
        cleaned.withColumn("timestamp", cleaned["scrape_timestamp"].cast("string")), threshold, method
    )


def offers_of(gold: DataFrame) -> DataFrame:
    """Offer rows of gold products with an order of arrival."""
    return analytics.explode_offers(gold).withColumn("ord", F.struct("product_id", "offer_pos"))


def analyze_market(gold: DataFrame) -> dict[str, DataFrame]:
    """All metric tables of gold products.

    The flagged offers hold all columns the metrics read, so they are the one
    copy that is written; it and the per-product table are read by everything
    downstream.
    """
    offers = flagged = materialise(analytics.is_lowest(offers_of(gold).drop("title", "unit", "offer_pos")))
    dispersion = materialise(analytics.price_dispersion(offers))
    profile = materialise(analytics.product_profile(offers, dispersion))
    scorecard = materialise(analytics.store_scorecard(offers, flagged))
    cat_ldi = materialise(analytics.category_dominance(flagged))
    tiers = analytics.brand_tier(offers)
    city_matrix = analytics.city_correlation(profile)
    correlations = [
        analytics.size_vs_dispersion(profile),
        analytics.competitors_vs_spread(profile),
        analytics.tier_vs_volatility(tiers),
    ]
    return {
        "product_dispersion_metrics": dispersion,
        "store_market_metrics": scorecard,
        "category_ldi_stats": cat_ldi,
        "report_tables": report.report_tables(
            analytics.market_overview(offers), scorecard, correlations, city_matrix, cat_ldi
        ),
    }


def end_to_end(raw: DataFrame, threshold: int = matching.THRESHOLD) -> dict[str, DataFrame]:
    """Raw listings to metric tables; an error in a stage stops the ones after it."""
    cleaned = materialise(clean_listings(raw))
    gold = materialise(match_listings(cleaned, threshold))
    return {"cleaned": cleaned, "gold": gold} | analyze_market(gold)


def clean_folder(spark: SparkSession, raw_folder: str, cleaned_folder: str, fmt: str = "parquet") -> None:
    """Raw listing files to landed cleaned listings."""
    with intermediates(spark):
        listing_io.write_cleaned(clean_listings(listing_io.read_raw_listings(spark, raw_folder)), cleaned_folder, fmt)


def clean_new_files(spark: SparkSession, landed_folder: str, cleaned_folder: str, state_folder: str) -> None:
    """Clean the markets of a landed raw feed that got files since the last call; leave the files of the others alone.

    Copies and outliers are judged over a whole feed, so a market with a new
    file is read and judged anew and its folder replaced.  A market never loses
    its last row by more data (no price is far from the median of its own
    category), so replacing what has rows is enough.  The names of the files
    seen are kept in ``state_folder``, added after the cleaned rows are in
    place: a call that fails is made good by the next one.
    """
    with intermediates(spark):
        files = materialise(listing_io.landed_files(spark, landed_folder))
        seen = listing_io.seen_files(spark, state_folder)
        new = materialise(files.join(seen, "path", "left_anti"))
        if new.isEmpty():
            return
        raw = listing_io.read_landed_listings(spark, landed_folder)
        # Markets whose names run together to the same feed are judged together, so they are replaced together.
        feeds = materialise(new.select("file_name").distinct())
        changed = materialise(files.join(feeds, "file_name", "left_semi").select(*listing_io.MARKET).distinct())
        here = [raw[c].eqNullSafe(changed[c]) for c in listing_io.MARKET]
        listing_io.replace_cleaned(clean_listings(raw.join(changed, here, "left_semi")), cleaned_folder)
        new.select("path").write.mode("append").parquet(state_folder)


def match_folder(
    spark: SparkSession,
    cleaned_folder: str,
    gold_folder: str,
    fmt: str = "parquet",
    legacy_folder: str | None = None,
    threshold: int = matching.THRESHOLD,
    method: str = "token_sort",
    index_folder: str | None = None,
) -> None:
    """Landed cleaned listings, older files in ``legacy_folder`` included, to gold products; their search index if wanted."""
    with intermediates(spark):
        cleaned = listing_io.read_landed_cleaned(spark, cleaned_folder, fmt)
        if legacy_folder:
            cleaned = listing_io.union_listings(cleaned, listing_io.read_legacy_cleaned(spark, legacy_folder))
        gold_io.write_gold(match_listings(cleaned, threshold, method), gold_folder)
        if index_folder:
            search.write_index(gold_io.read_gold(spark, gold_folder, "parquet"), index_folder)


def analyze_folder(spark: SparkSession, gold_folder: str, report_folder: str, fmt: str = "parquet") -> None:
    """Landed gold products to metric tables and the report's numbers."""
    with intermediates(spark):
        gold_io.write_metric_tables(analyze_market(gold_io.read_gold(spark, gold_folder, fmt)), report_folder)


def run_on_folders(spark: SparkSession, raw_folder: str, out_folder: str) -> None:
    """Raw listing files in; cleaned listings, gold products and reports out, each stage reading what the last one landed."""
    clean_folder(spark, raw_folder, f"{out_folder}/processed")
    match_folder(spark, f"{out_folder}/processed", f"{out_folder}/matched/products")
    gold_io.write_flat_gold(gold_io.read_gold(spark, f"{out_folder}/matched/products", "parquet"), f"{out_folder}/matched/products_csv")
    analyze_folder(spark, f"{out_folder}/matched/products", f"{out_folder}/reports")
