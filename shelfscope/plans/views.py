"""Offers, listings and gold products seen through the star schema's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators.matching import assemble_gold, best_offer, product_facts

# Sizes written after the part names, by key modulo 6.
LISTING_UNITS = ["kg", "g", "ml", "L", " pcs", " per dozen"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the nation keys of their supplier and their customer.

    Orders meet their customers first and names come last, so that the line
    items are shuffled once, as numbers.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    buyers = orders.join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_nationkey")
    # The suppliers join as a plain scan, so their file size decides by itself
    # whether they are broadcast.
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(buyers, lines.l_orderkey == buyers.o_orderkey)


def _named(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    """:func:`_lines` with the region of the supplier as ``store`` and the nation of the customer as ``city``."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("store"))
    homes = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    cities = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    return lines.join(homes, "s_nationkey").join(regions, "r_regionkey").join(cities, "c_nationkey")


def _unit_price() -> Column:
    return F.round(F.try_divide("l_extendedprice", "l_quantity"), 2)


def offers_view(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as offers: a part is a product, a supplier's region the store,
    a customer's nation the city."""
    lines = _lines(spark, folder)
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return _named(spark, folder, lines.join(parts, lines.l_partkey == parts.p_partkey)).select(
        F.col("l_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("double").alias("quantity"),
        F.lit("unit").alias("unit"),
        F.col("p_type").alias("category"),
        "store",
        "city",
        F.col("l_extendedprice").alias("price"),
        _unit_price().alias("unit_price"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ord"),
        F.col("l_shipdate").cast("string").alias("timestamp"),
    )


def gold_view(spark: SparkSession, folder: str) -> DataFrame:
    """Gold products whose clusters are the parts.

    The line items are folded without the columns of their part; these join
    the products.
    """
    offers = _named(spark, folder, _lines(spark, folder)).select(
        F.col("l_partkey").alias("product_id"),
        "store",
        "city",
        F.col("l_extendedprice").alias("price"),
        _unit_price().alias("unit_price"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ord"),
        F.col("l_shipdate").alias("timestamp"),
    )
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("double").alias("quantity"),
        F.lit("unit").alias("unit"),
        F.col("p_type").alias("category"),
    )
    return assemble_gold(best_offer(offers, ["product_id"], facts=False), ["product_id"], product_facts(parts, ["product_id"]))


def listing_view(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as raw listings with a size in the name and two prices in the price text."""
    part = table(spark, folder, "part")
    units = F.array(*[F.lit(u) for u in LISTING_UNITS])
    money = [F.format_string("%.2f", F.round(F.col("p_retailprice") * k, 2)) for k in (1.0, 0.9)]
    return part.select(
        F.col("p_brand").alias("store"),
        F.concat(F.lit("City "), (F.col("p_partkey") % 3).cast("string")).alias("city"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.concat(
            "p_name", F.lit(" "), F.col("p_size").cast("string"), units[(F.col("p_partkey") % 6).cast("int")]
        ).alias("name"),
        F.lit("Generic").alias("brand"),
        F.col("p_type").alias("category"),
        F.lit("").alias("subcategory"),
        F.concat(F.lit("Rs. "), money[0], F.lit(" Rs."), money[1]).alias("price"),
        F.lit("In Stock").alias("availability"),
        F.lit("").alias("product_url"),
        F.lit("").alias("image_url"),
        F.col("p_partkey").cast("string").alias("timestamp"),
        F.lit("part").alias("file_name"),
        F.col("p_partkey").alias("row_pos"),
    )
