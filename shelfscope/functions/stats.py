"""Grouped statistics that stay exact and stay spread out.

A group may hold a third of all rows, so nothing here gathers a group's values
into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.session import materialise

MOST_IN_BIN = 1 << 14  # distinct values that are ranked together
DIGIT = 12  # bits of the order key a histogram looks at
SHIFTS = [52, 40, 28, 16, 4, 0]


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows whose group key is NULL."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side."""
    x, y = nan_to_null(x.cast("double")), nan_to_null(y.cast("double"))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def attach(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table of group statistics back onto the rows of its groups.

    The table is materialised first.  Its size is then known: a small one is
    broadcast and the rows are not shuffled at all, a large one is joined by a
    sort-merge join whose two inputs are plain shuffles, which is the shape
    adaptive execution can split when one key is hot.
    """
    return df.join(materialise(table), keys, how)


def order_key(value: Column) -> Column:
    """A double as a whole number of equal order: its IEEE bits, negated for negative numbers.

    Powers of two and quotients by them are exact, so no two doubles share a key.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))  # may be one off next to a power of two
    power = guess + F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0) - F.when(size < F.pow(F.lit(2.0), guess), 1).otherwise(0)
    whole = F.lit(2.0**52)
    normal = (power + 1023).cast("long") * (1 << 52) + ((size / F.pow(F.lit(2.0), power) - 1) * whole).cast("long")
    bits = (
        F.when(size == float("inf"), F.lit(2047 << 52))
        .when(size >= 2.0**-1022, normal)
        .otherwise((size * 2.0**537 * 2.0**537).cast("long"))
    )
    return F.when(value < 0, -bits).otherwise(bits)


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    *,
    weight: str | None = None,
    moments: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group.

    ``weight`` names a column of repeat counts; rows are then distinct values,
    or few rows share one, and are not merged again.  ``moments`` are further
    aggregates of the same groups.
    """
    moments = moments or {}
    rows = with_keys(df, *keys)
    measured = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if weight:
        counted = measured.select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_n"))
    else:
        counted = materialise(measured.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    picked = _quantiles(counted, keys, probs)
    if not moments:
        return picked
    sums = rows.groupBy(*keys).agg(*[c.alias(name) for name, c in moments.items()])
    return sums.join(picked, keys, "left").select(*keys, *probs, *moments)


def _places(probs: dict[str, float]) -> dict[str, Column]:
    return {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in probs.items()}


def _quantiles(counted: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of distinct values ``_v`` that stand ``_n`` times each.

    A group of up to ``MOST_IN_BIN`` distinct values is ranked as it is.  Of
    larger ones histograms over the leading bits of the values' order keys tell
    which bins hold the wanted ranks; only these bins' values are looked at
    again, over the next bits, until a bin has so few distinct values.  Nothing
    is sorted across the cluster and no task holds a large group; a histogram
    has at most ``2**DIGIT`` rows a group.
    """
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"), F.sum("_n").alias("_total"))
    large = sizes.filter(F.col("_values") > MOST_IN_BIN)
    if large.isEmpty():
        parts = counted.withColumns({"_bin": F.lit(0), "_before": F.lit(0).cast("long")})
        whole = F.sum("_n").over(Window.partitionBy(*keys))
        return _interpolated(_ranked(parts.withColumn("_total", whole), keys), keys, probs)
    large = materialise(large.drop("_values"))
    few = counted.join(large, keys, "left_anti").withColumns({"_bin": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")})
    few = few.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    rows = counted.join(large, keys).withColumn("_key", order_key(F.col("_v")))
    rows = rows.withColumns({"_bin": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")})
    found = [_ranked(few, keys)]
    for shift in SHIFTS:
        bins = materialise(_wanted_bins(rows, keys, probs, shift))
        here = rows.drop("_bin", "_before", "_total").withColumn("_bin", F.shiftright("_key", shift)).join(bins, [*keys, "_bin"])
        found.append(_ranked(here.filter("_ready"), keys))
        rows = here.filter("not _ready").drop("_ready")
        if not shift or bins.filter("not _ready").isEmpty():
            break
    return _interpolated(reduce(DataFrame.unionByName, found), keys, probs)


def _wanted_bins(rows: DataFrame, keys: list[str], probs: dict[str, float], shift: int) -> DataFrame:
    """The bins of the next bits that hold a wanted rank, how many rows stand before them, and whether they are small."""
    histogram = rows.groupBy(*keys, "_total", "_before", F.col("_bin").alias("_parent"), F.shiftright("_key", shift).alias("_bin")).agg(
        F.sum("_n").alias("_here"), F.count(F.lit(1)).alias("_values")
    )
    running = F.sum("_here").over(Window.partitionBy(*keys, "_parent").orderBy("_bin"))
    bins = histogram.withColumn("_before", F.col("_before") + running - F.col("_here"))
    ranks = F.array(*[f(place).cast("long") for place in _places(probs).values() for f in (F.floor, F.ceil)])
    holds = F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_here")))
    ready = (F.col("_values") <= MOST_IN_BIN) | F.lit(shift == 0)
    return bins.filter(holds).select(*keys, "_bin", "_before", "_total", ready.alias("_ready"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a bin with the ranks they take: from ``_from`` up to ``_upto``."""
    # Row by row: where rows were not merged, equal values stand in several.
    running = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.sum("_n").over(running)
    return rows.withColumn("_upto", upto).select(*keys, "_v", "_total", (F.col("_upto") - F.col("_n")).alias("_from"), "_upto")


def _interpolated(ranked: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    def at(rank: Column) -> Column:
        rank = rank.cast("long")
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_upto")), F.col("_v")))

    places = _places(probs)
    picked = ranked.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[at(F.floor(place)).alias(f"_lo_{name}") for name, place in places.items()],
        *[at(F.ceil(place)).alias(f"_hi_{name}") for name, place in places.items()],
    )
    between = {
        name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place - F.floor(place))
        for name, place in places.items()
    }
    return picked.select(*keys, *[column.alias(name) for name, column in between.items()])
