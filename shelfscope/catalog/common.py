"""What the registered queries share: rounding, SQL fragments, scratch folders."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.session import shared_folder


def tidied(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that the order of summation does not show.

    The tiny shift moves exact halves off the rounding boundary; the SQL side
    does the same in :func:`r`.
    """
    return df.select(
        *[
            (F.round(F.col(f.name) + 1e-9, 6) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


def r(expr: str) -> str:
    return f"(round(({expr}) + 1e-9, 6) + 0.0)"


def cents(expr: str) -> str:
    """Half-up rounding to the cent of the number as it is written."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE)"


def scratch(spark: SparkSession) -> str:
    """A new folder for a round trip through files."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def long_form(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Tables of one kind of row: table, key (its key columns as one text), measure and value."""
    parts = []
    for name, (table, keys) in tables.items():
        measures = [c for c in table.columns if c not in keys]
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        pairs = F.array(
            *[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("double").alias("value")) for m in measures]
        )
        parts.append(table.select(F.lit(name).alias("table"), key.alias("key"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def long_sql(name: str, table: str, keys: list[str], measures: list[str]) -> str:
    """The SELECT that puts a table expression into the form of :func:`long_form`."""
    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", {key} AS key, '{m}' AS measure, {r(f'CAST("{m}" AS DOUBLE)')} AS value FROM {table}"""
        for m in measures
    )


def with_ctes(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


OFFERS = f"""
offers AS (
  SELECT l_partkey AS product_id, p_name AS title, p_brand AS brand,
         CAST(p_size AS DOUBLE) AS quantity, 'unit' AS unit, p_type AS category,
         r_name AS store, cn.n_name AS city, l_extendedprice AS price,
         {cents("l_extendedprice / l_quantity")} AS unit_price,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "timestamp",
         l_orderkey, l_linenumber,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS ord
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN region ON sn.n_regionkey = r_regionkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
)"""

BEST = """
best AS (
  SELECT product_id, store, city,
         arg_min(struct_pack(price := price, unit_price := unit_price, "timestamp" := "timestamp"), (price, ord)) AS o,
         min(ord) AS first_ord, count(*) AS n
  FROM offers GROUP BY product_id, store, city
)"""

GOLD = (
    BEST
    + """,
gold AS (
  SELECT b.product_id, p_name AS title, p_brand AS brand, CAST(p_size AS DOUBLE) AS quantity,
         'unit' AS unit, p_type AS category,
         list(struct_pack(store := store, city := city, price := o.price, unit_price := o.unit_price,
                          "timestamp" := o."timestamp")
              ORDER BY first_ord) AS offers,
         min(o.price) AS min_price, max(o.price) AS max_price,
         count(*) AS match_count, CAST(sum(n) AS BIGINT) AS cluster_size
  FROM best b JOIN part ON b.product_id = p_partkey
  GROUP BY b.product_id, p_name, p_brand, p_size, p_type
)"""
)

LISTINGS = """
listings AS (
  SELECT p_brand AS store, 'City ' || CAST(p_partkey % 3 AS VARCHAR) AS city,
         CAST(p_partkey AS VARCHAR) AS product_id,
         p_name || ' ' || CAST(p_size AS VARCHAR)
           || ['kg', 'g', 'ml', 'L', ' pcs', ' per dozen'][CAST(p_partkey % 6 AS INTEGER) + 1] AS name,
         'Generic' AS brand, p_type AS category, '' AS subcategory,
         'Rs. ' || printf('%.2f', money(p_retailprice)) || ' Rs.' || printf('%.2f', money(p_retailprice * 0.9)) AS price,
         'In Stock' AS availability, '' AS product_url, '' AS image_url,
         CAST(p_partkey AS VARCHAR) AS "timestamp", 'part' AS file_name, p_partkey AS row_pos
  FROM part
)"""
for call in ("p_retailprice * 0.9", "p_retailprice"):
    LISTINGS = LISTINGS.replace(f"money({call})", cents(call))

LCS = """
list_reduce(string_split({a}, ''),
  lambda dp, ch: list_reduce(range(1, length({b}) + 1),
     lambda acc, j: list_append(acc, CASE WHEN substr({b}, j, 1) = ch THEN dp[j] + 1
                                       ELSE greatest(acc[j], dp[j + 1]) END), [CAST(0 AS BIGINT)]),
  list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT)))[-1]"""
