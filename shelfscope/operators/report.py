"""The numbers of the market report as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators import analytics

SCORECARD_METRICS = [
    "avg_category_price_index",
    "ldi",
    "weighted_ldi",
    "leadership_frequency",
    "median_price_deviation",
]
CITY_METRICS = ["mean", "std", "cv"]


def _long(df: DataFrame, section: str, key: F.Column, metrics: list[str]) -> DataFrame:
    """Melt metric columns to (section, key, metric, value)."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(pairs))


def report_tables(
    overview: DataFrame,
    scorecard: DataFrame,
    correlations: list[DataFrame],
    city_matrix: DataFrame,
    cat_ldi: DataFrame,
) -> DataFrame:
    """Overview, store scorecard, correlations, city matrices and top categories."""
    sections = [
        _long(
            overview,
            "overview",
            F.lit("market"),
            ["offer_rows", "products", "brands", "synchronization_score"],
        ),
        _long(scorecard, "scorecard", F.concat_ws(" / ", "store", "city"), SCORECARD_METRICS),
    ]
    sections += [_long(c, "correlation", F.lit("market"), c.columns) for c in correlations]
    sections.append(
        city_matrix.filter(F.col("var_x").isin(*CITY_METRICS) & F.col("var_y").isin(*CITY_METRICS)).select(
            F.lit("city_matrix").alias("section"),
            F.col("city").alias("key"),
            F.concat_ws(" ~ ", "var_x", "var_y").alias("metric"),
            F.col("corr").alias("value"),
        )
    )
    sections.append(_long(analytics.top_categories(cat_ldi), "top_categories", F.col("category"), ["cat_ldi"]))
    return reduce(DataFrame.unionByName, sections)
