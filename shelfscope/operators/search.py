"""Search over landed products by an index of the letters they hold.

Every three neighbouring characters of a lower-cased title or brand are a gram.
The index holds a row per gram and product, in buckets by gram, and a copy of
the products in parts by id; both are laid out so that a search reads the
buckets of its own grams and the parts of the products these name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.operators.explore import SEARCH_RESULTS, product_search
from shelfscope.schemas import GOLD
from shelfscope.session import materialise

GRAM = 3
BUCKETS = 64  # of grams
PARTS = 64  # of products


def grams(text: Column) -> Column:
    """The distinct grams of a text, lower-cased; none of a shorter text or NULL."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1)))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))), F.array().cast("array<string>"))


def _bucket(value: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(size)).cast("int")


def _products(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(T.StructType([*GOLD.fields, T.StructField("part", T.IntegerType())])).parquet(f"{folder}/products")


def write_index(gold: DataFrame, folder: str) -> None:
    """Replace the index of gold products: ``postings`` and ``products`` under the folder.

    A gram that most products hold is a row per product, in files of equal size,
    never one list.  Grams are taken from the landed products, so that the gold
    is made once.
    """
    products = gold.withColumn("part", _bucket(F.col("product_id"), PARTS))
    products = products.hint("rebalance", "part").sortWithinPartitions("part", "product_id")
    products.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/products")
    found = F.explode(F.array_union(grams(F.col("title")), grams(F.col("brand")))).alias("gram")
    landed = _products(gold.sparkSession, folder)
    postings = landed.select("product_id", found).withColumn("bucket", _bucket(F.col("gram"), BUCKETS))
    postings = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "product_id")
    postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("gram string, product_id string, bucket int").parquet(f"{folder}/postings")


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """Ids and parts of the products that hold all grams of the query; None when it is too short to have one."""
    # The session lower-cases the query, so that both sides follow one rule.
    wanted = spark.range(1).select(grams(F.lit(query))).first()[0]
    if not wanted:
        return None
    buckets = [_bucket(F.lit(gram), BUCKETS) for gram in wanted]
    hits = _postings(spark, folder).filter(F.col("bucket").isin(*buckets) & F.col("gram").isin(*wanted)).groupBy("product_id")
    full = hits.agg(F.countDistinct("gram").alias("_grams")).filter(F.col("_grams") == len(wanted))
    return full.select("product_id", _bucket(F.col("product_id"), PARTS).alias("part"))


def matching_products(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """The indexed products that may match a query: all that do, and a few that hold its grams elsewhere.

    A query of fewer than three characters reads all products.
    """
    products = _products(spark, folder)
    found = candidates(spark, folder, query)
    if found is None:
        return products.drop("part")
    found = materialise(found)
    parts = materialise(found.select("part").distinct()).filter("part >= 0")  # at most PARTS rows
    products = products.join(F.broadcast(parts), "part", "left_semi")
    return products.join(found.select("product_id"), "product_id", "left_semi").drop("part")


def indexed_search(
    spark: SparkSession,
    folder: str,
    query: str,
    n: int = SEARCH_RESULTS,
    order: str = "product_id",
    cities: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`~shelfscope.operators.explore.product_search` over an index written by :func:`write_index`."""
    return product_search(matching_products(spark, folder, query), query, n, order, cities)
