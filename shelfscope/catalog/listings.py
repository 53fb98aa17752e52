"""Queries over raw listings: text parsing, cleaning, sources and sinks, stage jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.catalog.common import BEST, GOLD, LISTINGS, OFFERS, cents, r, scratch, tidied, with_ctes
from shelfscope.catalog import market
from shelfscope.catalog.market import CAT_LDI, FLAGGED, SCORECARD, _SCORE, rounded
from shelfscope.functions import text
from shelfscope.operators import analytics, cleaning
from shelfscope.plans import jobs
from shelfscope.plans.views import gold_view, listing_view, table
from shelfscope.schemas import RAW_FIELDS
from shelfscope.session import materialise
from shelfscope.sources import gold as gold_io
from shelfscope.sources import listings as listing_io

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    """Register a function of (spark, folder) under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: tidied(f(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


RAW_COLUMNS = ", ".join(f'"{c}"' for c in RAW_FIELDS)

# --- parsing, one column at a time ---

PRICE_SQL = r"TRY_CAST(replace(list_extract(regexp_extract_all({0}, 'Rs\.?\s*([\d,]+(\.\d+)?)', 1), -1), ',', '') AS DOUBLE)"
UNITS_SQL = "MAP {" + ", ".join(f"'{u}': '{s}'" for u, s, _ in text.UNITS) + "}"
FACTORS_SQL = "MAP {" + ", ".join(f"'{u}': CAST({m!r} AS DOUBLE)" for u, _, m in text.UNITS) + "}"
_QTY = r"(?i)(\d+(\.\d+)?)\s*(kg|g|gm|gram|grams|ml|l|liter|liters|mg|doz|dozen|pcs|pieces|per Dozen|per Doz)"
NUMBER_SQL = f"TRY_CAST(nullif(regexp_extract({{0}}, '{_QTY}', 1), '') AS DOUBLE)"
TOKEN_SQL = f"lower(regexp_extract({{0}}, '{_QTY}', 3))"
QUANTITY_SQL = f"""CASE WHEN contains(lower({{0}}), 'per doz') THEN 12.0
  WHEN {NUMBER_SQL} IS NOT NULL THEN {NUMBER_SQL} * coalesce({FACTORS_SQL}[{TOKEN_SQL}], CAST(1 AS DOUBLE))
  ELSE 1.0 END"""
UNIT_SQL = f"""CASE WHEN contains(lower({{0}}), 'per doz') THEN 'pcs'
  WHEN {TOKEN_SQL} <> '' THEN coalesce({UNITS_SQL}[{TOKEN_SQL}], {TOKEN_SQL}) ELSE 'unit' END"""
BRAND_SQL = (
    "CASE "
    + " ".join(f"WHEN contains(lower({{0}}), '{key}') THEN '{label}'" for key, label in text.BRANDS)
    + r" ELSE coalesce(nullif(regexp_extract({0}, '\S+'), ''), 'Generic') END"
)


def sql_of(template: str, column: str) -> str:
    """Fill a template whose own braces (map literals) must stay."""
    return template.replace("{0}", column)


def _double(sql: str) -> str:
    return f"CAST({sql} AS DOUBLE)"


# Price texts with thousands separators, two prices, one, a wrong marker, or none.
PRICE_TEXTS = f"""
texts AS (
  SELECT p_partkey, p_name || ' Rs.' || printf('%.2f', {cents("p_retailprice * 0.5")}) AS name,
         CASE p_partkey % 4
           WHEN 0 THEN 'Rs. ' || format('{{:,.2f}}', {cents("p_retailprice * 3")}) || ' Rs.' || printf('%.2f', p_retailprice)
           WHEN 1 THEN 'Rs ' || printf('%.2f', p_retailprice)
           WHEN 2 THEN 'rs ' || printf('%.2f', p_retailprice)
           ELSE '' END AS price
  FROM part
)"""


def _price_texts(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")

    def money(k: float, pattern: str = "%.2f") -> F.Column:
        return F.format_string(pattern, F.round(F.col("p_retailprice") * k, 2))

    kind = F.col("p_partkey") % 4
    return part.select(
        "p_partkey",
        F.concat("p_name", F.lit(" Rs."), money(0.5)).alias("name"),
        F.when(kind == 0, F.concat(F.lit("Rs. "), money(3, "%,.2f"), F.lit(" Rs."), money(1)))
        .when(kind == 1, F.concat(F.lit("Rs "), money(1)))
        .when(kind == 2, F.concat(F.lit("rs "), money(1)))
        .otherwise(F.lit(""))
        .alias("price"),
    )


@query(with_ctes(PRICE_TEXTS, select=f"SELECT p_partkey, price, {PRICE_SQL.replace('{0}', 'price')} AS value FROM texts"))
def clean_price(spark, folder):
    return _price_texts(spark, folder).select("p_partkey", "price", text.clean_price(F.col("price")).alias("value"))


@query(
    with_ctes(
        PRICE_TEXTS,
        select=f"""SELECT p_partkey, coalesce({PRICE_SQL.replace('{0}', 'price')}, {PRICE_SQL.replace('{0}', 'name')})
                   AS value FROM texts""",
    )
)
def price_or_name_price(spark, folder):
    return _price_texts(spark, folder).select(
        "p_partkey", text.price_or_name_price(F.col("price"), F.col("name")).alias("value")
    )


@query(
    with_ctes(
        LISTINGS,
        select=f"""SELECT product_id, name, {r(_double(sql_of(QUANTITY_SQL, 'name')))} AS quantity,
                   {sql_of(UNIT_SQL, 'name')} AS unit FROM listings""",
    )
)
def parse_quantity(spark, folder):
    name = F.col("name")
    return listing_view(spark, folder).select(
        "product_id", "name", text.quantity_value(name).alias("quantity"), text.quantity_unit(name).alias("unit")
    )


UNIT_WORDS = [u for u, _, _ in text.UNITS] + ["box", "tin"]
_WORD = f"{UNIT_WORDS!r}[CAST(p_partkey % {len(UNIT_WORDS)} AS INTEGER) + 1]"


@query(
    f"""SELECT p_partkey, {_WORD} AS word, coalesce({UNITS_SQL}[{_WORD}], {_WORD}) AS unit,
        {r(f"p_size * coalesce({FACTORS_SQL}[{_WORD}], CAST(1 AS DOUBLE))")} AS amount FROM part"""
)
def to_standard_unit(spark, folder):
    words = F.array(*[F.lit(u) for u in UNIT_WORDS])
    rows = table(spark, folder, "part").withColumn("word", words[(F.col("p_partkey") % len(UNIT_WORDS)).cast("int")])
    return rows.select(
        "p_partkey",
        "word",
        text.standard_unit(F.col("word")).alias("unit"),
        (F.col("p_size") * text.unit_multiplier(F.col("word"))).alias("amount"),
    )


BRANDED_WORDS = ["", "International", "Lux", "NESTLE", "surf excel", "luxury Dalda", "tapal Lipton", "Ponam"]
_BRANDED = f"trim({BRANDED_WORDS!r}[CAST(p_partkey % {len(BRANDED_WORDS)} AS INTEGER) + 1] || ' ' || p_name)"


@query(
    f"""SELECT p_partkey, {_BRANDED} AS title, {sql_of(BRAND_SQL, _BRANDED)} AS brand,
        CASE WHEN p_partkey % 3 = 0 THEN {sql_of(BRAND_SQL, _BRANDED)} ELSE p_brand END AS resolved FROM part"""
)
def extract_brand(spark, folder):
    words = F.array(*[F.lit(w) for w in BRANDED_WORDS])
    word = words[(F.col("p_partkey") % len(BRANDED_WORDS)).cast("int")]
    rows = table(spark, folder, "part").withColumn("title", F.trim(F.concat_ws(" ", word, "p_name")))
    stated = F.when(F.col("p_partkey") % 3 == 0, F.lit("Generic")).otherwise(F.col("p_brand"))
    return rows.select(
        "p_partkey",
        "title",
        text.extract_brand(F.col("title")).alias("brand"),
        text.resolve_brand(stated, F.col("title")).alias("resolved"),
    )


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, {cents('l_extendedprice / l_quantity')} AS unit_price FROM lineitem")
def unit_price(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        text.unit_price(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
    )


def _parsed(source: str, name: str) -> str:
    """Common table expression: cleaned columns of a raw table."""
    price = f"coalesce({PRICE_SQL.replace('{0}', 'price')}, {PRICE_SQL.replace('{0}', 'name')})"
    up = cents("price_value / quantity")
    return f"""
{name} AS (
  SELECT file_name, row_pos, product_id, name, brand_value AS brand, category, subcategory,
         price_value AS price, quantity, unit,
         CASE WHEN price_value <> 0 AND quantity > 0 THEN {up} END AS unit_price,
         availability, store, city
  FROM (SELECT *, {price} AS price_value, {_double(sql_of(QUANTITY_SQL, 'name'))} AS quantity,
               {sql_of(UNIT_SQL, 'name')} AS unit,
               CASE WHEN brand IN ('', 'Generic') THEN {sql_of(BRAND_SQL, 'name')} ELSE brand END AS brand_value
        FROM {source})
)"""


_CLEANED = "product_id, name, brand, category, subcategory, availability, store, city, unit"
_NUMBERS = ["price", "quantity", "unit_price"]
_KEPT = [*_CLEANED.split(", "), *_NUMBERS]


@query(rounded("parsed", _CLEANED, _NUMBERS, LISTINGS, _parsed("listings", "parsed")))
def normalize_listing(spark, folder):
    return cleaning.normalize_listing(listing_view(spark, folder)).select(*_KEPT)


# Three feeds; every listing twice in its feed, and some prices far too high.
FEEDS_SQL = (
    LISTINGS
    + f""",
feeds AS (
  SELECT 'feed' || CAST(row_pos % 3 AS VARCHAR) AS file_name, row_pos + copy * 1000000000 AS row_pos,
         store, city, product_id, name, brand, category, subcategory,
         CASE WHEN row_pos % 97 = 0 THEN 'Rs. ' || printf('%.2f', {cents("p_retailprice * 60")}) ELSE price END AS price,
         availability, product_url, image_url, "timestamp"
  FROM listings JOIN part ON row_pos = p_partkey, (VALUES (0), (1)) t(copy)
)"""
)
DEDUP_SQL = """
firsts AS (
  SELECT * FROM feeds
  QUALIFY row_number() OVER (PARTITION BY file_name, name, price, store, city ORDER BY row_pos) = 1
)"""
CLEAN_SQL = """
required AS (SELECT * FROM parsed WHERE name <> '' AND store <> '' AND price <> 0),
sane AS (SELECT * FROM required WHERE unit_price > 1 AND unit_price < 100000),
judged AS (
  SELECT *, count(*) OVER w AS n, avg(price) OVER w AS mean, stddev_pop(price) OVER w AS std,
         quantile_cont(price, 0.25) OVER w AS q1, quantile_cont(price, 0.75) OVER w AS q3
  FROM sane WINDOW w AS (PARTITION BY file_name, category)
),
reasons AS (
  SELECT *, q1 - 2.5 * (q3 - q1) AS lower, q3 + 2.5 * (q3 - q1) AS upper,
         CASE WHEN n < 5 THEN NULL
              WHEN CASE WHEN std > 0 THEN abs((price - mean) / std) ELSE 0 END > 5 THEN 'z-score'
              WHEN price < q1 - 2.5 * (q3 - q1) OR price > q3 + 2.5 * (q3 - q1) THEN 'iqr' END AS reason
  FROM judged
)"""


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    rows = listing_view(spark, folder)
    dear = F.format_string("Rs. %.2f", F.round(F.col("p_retailprice") * 60, 2))
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("row_pos"), dear.alias("dear"))
    return (
        rows.join(part, "row_pos")
        .withColumn("price", F.when(F.col("row_pos") % 97 == 0, F.col("dear")).otherwise(F.col("price")))
        .withColumn("file_name", F.concat(F.lit("feed"), (F.col("row_pos") % 3).cast("string")))
        .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("row_pos", F.col("row_pos") + F.col("copy") * 1000000000)
        .drop("copy", "dear")
    )


@query(with_ctes(FEEDS_SQL, DEDUP_SQL, select="SELECT file_name, row_pos, store, city, name, price FROM firsts"))
def dedup_first(spark, folder):
    return cleaning.dedup_first(feeds(spark, folder)).select("file_name", "row_pos", "store", "city", "name", "price")


_STAGE = "file_name, row_pos, " + _CLEANED
_STAGED = ["file_name", "row_pos", *_KEPT]


def _parsed_feeds(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.normalize_listing(cleaning.dedup_first(feeds(spark, folder)))


# Some names and stores are blanked to have something to require.
BLANKED_SQL = """
blanked AS (
  SELECT * REPLACE (CASE WHEN row_pos % 11 = 0 THEN '' ELSE name END AS name,
                    CASE WHEN row_pos % 13 = 0 THEN '' ELSE store END AS store,
                    CASE WHEN row_pos % 17 = 0 THEN 'Rs. 0' ELSE price END AS price)
  FROM feeds
)"""


@query(
    rounded(
        "kept",
        _STAGE,
        _NUMBERS,
        FEEDS_SQL,
        BLANKED_SQL,
        _parsed("blanked", "parsed"),
        "kept AS (SELECT * FROM parsed WHERE name <> '' AND store <> '' AND price <> 0)",
    )
)
def require_fields(spark, folder):
    def blank(every: int, name: str, value: str) -> F.Column:
        return F.when(F.col("row_pos") % every == 0, F.lit(value)).otherwise(F.col(name))

    rows = feeds(spark, folder).withColumns(
        {"name": blank(11, "name", ""), "store": blank(13, "store", ""), "price": blank(17, "price", "Rs. 0")}
    )
    return cleaning.require_fields(cleaning.normalize_listing(rows)).select(*_STAGED)


@query(
    rounded(
        "kept",
        _STAGE,
        _NUMBERS,
        FEEDS_SQL,
        _parsed("feeds", "parsed"),
        "kept AS (SELECT * FROM parsed WHERE unit_price > 1 AND unit_price < 100000)",
    )
)
def sane_unit_price(spark, folder):
    return cleaning.sane_unit_price(cleaning.normalize_listing(feeds(spark, folder))).select(*_STAGED)


_FULL_CLEAN = (FEEDS_SQL, DEDUP_SQL, _parsed("firsts", "parsed"), CLEAN_SQL)


@query(
    rounded(
        "kept", _STAGE, _NUMBERS, *_FULL_CLEAN, "kept AS (SELECT * FROM reasons WHERE reason IS NULL)"
    )
)
def category_outlier_filter(spark, folder):
    rows = cleaning.sane_unit_price(cleaning.require_fields(_parsed_feeds(spark, folder)))
    return cleaning.category_outlier_filter(materialise(rows)).select(*_STAGED)


@query(
    rounded(
        "dropped",
        _STAGE + ", reason",
        [*_NUMBERS, "mean", "std", "lower", "upper"],
        *_FULL_CLEAN,
        "dropped AS (SELECT * FROM reasons WHERE reason IS NOT NULL)",
    )
)
def outlier_audit(spark, folder):
    rows = cleaning.sane_unit_price(cleaning.require_fields(_parsed_feeds(spark, folder)))
    return cleaning.outlier_audit(materialise(rows)).select(*_STAGED, "reason", "mean", "std", "lower", "upper")


@query(
    rounded("kept", _CLEANED, _NUMBERS, *_FULL_CLEAN, "kept AS (SELECT * FROM reasons WHERE reason IS NULL)")
)
def clean_listings(spark, folder):
    return jobs.clean_listings(feeds(spark, folder)).select(*_KEPT)


# --- sources and sinks: written, read back, compared with what was written ---

# Names over two lines with quotes and commas in them.
AWKWARD_SQL = (
    LISTINGS
    + """,
awkward AS (SELECT * REPLACE (name || chr(10) || '"' || price || '", new' AS name) FROM listings)"""
)


def _awkward(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat("name", F.lit('\n"'), "price", F.lit('", new'))
    return listing_view(spark, folder).withColumn("name", name)


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


@query(with_ctes(AWKWARD_SQL, select=f"SELECT {RAW_COLUMNS} FROM awkward"))
def read_raw_listings(spark, folder):
    path = scratch(spark)
    _write_csv(_awkward(spark, folder).select(*RAW_FIELDS), path)
    return listing_io.read_raw_listings(spark, path).select(*RAW_FIELDS)


@query(with_ctes(AWKWARD_SQL, select=f"SELECT {RAW_COLUMNS} FROM awkward"))
def read_raw_in_any_order(spark, folder):
    """Files of one folder with different orders of columns, one lacking some that are empty, one with another."""
    path = scratch(spark)
    rows = _awkward(spark, folder)
    _write_csv(rows.filter("row_pos % 2 = 0").select(*RAW_FIELDS[::-1]), f"{path}/a")
    lacking = [c for c in RAW_FIELDS if c not in ("subcategory", "image_url")]
    _write_csv(rows.filter("row_pos % 2 = 1").select("price", F.lit("x").alias("colour"), *[c for c in lacking if c != "price"]), f"{path}/b")
    return listing_io.read_raw_listings(spark, path).select(*RAW_FIELDS)


@query(with_ctes(AWKWARD_SQL, select=f"SELECT {RAW_COLUMNS} FROM awkward"))
def read_raw_with_many_columns(spark, folder):
    """A file whose hundred other columns come first, next to one without any."""
    path = scratch(spark)
    rows = _awkward(spark, folder)
    others = [F.lit(f"x,{i}").alias(f"other_{i}") for i in range(100)]
    _write_csv(rows.filter("row_pos % 2 = 0").select(*others, *RAW_FIELDS), f"{path}/a")
    _write_csv(rows.filter("row_pos % 2 = 1").select(*RAW_FIELDS), f"{path}/b")
    return listing_io.read_raw_listings(spark, path).select(*RAW_FIELDS)


_PARSED_LISTINGS = (LISTINGS, _parsed("listings", "parsed"))


@query(rounded("parsed", _CLEANED, _NUMBERS, *_PARSED_LISTINGS))
def read_cleaned_listings(spark, folder):
    path = scratch(spark)
    _write_csv(cleaning.normalize_listing(listing_view(spark, folder)).drop("file_name", "row_pos"), path)
    return listing_io.read_cleaned_listings(spark, path, pattern="*.csv").select(*_KEPT)


@query(rounded("parsed", "name, brand, store, city, category, unit", _NUMBERS, *_PARSED_LISTINGS))
def read_legacy_cleaned(spark, folder):
    path = scratch(spark)
    names = ["name", "brand", *_NUMBERS, "unit", "store", "city", "category"]
    cleaning.normalize_listing(listing_view(spark, folder)).select(*names).withColumnRenamed("name", "title").write.json(path)
    return listing_io.read_legacy_cleaned(spark, path).select(*names)


@query(with_ctes(LISTINGS, select=f"SELECT {RAW_COLUMNS} FROM listings"))
def append_raw_listings(spark, folder):
    path = scratch(spark)
    rows = listing_view(spark, folder)
    listing_io.append_raw_listings(rows.filter(F.col("row_pos") % 2 == 0), path)
    listing_io.append_raw_listings(rows.filter(F.col("row_pos") % 2 == 1), path)
    return listing_io.read_landed_listings(spark, path).select(*RAW_FIELDS)


@query(rounded("parsed", _CLEANED, _NUMBERS, *_PARSED_LISTINGS))
def write_cleaned(spark, folder):
    path = scratch(spark)
    listing_io.write_cleaned(cleaning.normalize_listing(listing_view(spark, folder)), path)
    return spark.read.parquet(path).select(*_KEPT)


# Copies of the listings as one category, each market a feed.
_MARKET_FEEDS_SQL = (
    FEEDS_SQL.replace("feeds AS", "copies AS", 1)
    + """,
feeds AS (
  SELECT * REPLACE (store || '_' || city AS file_name, 'all' AS category, "timestamp" AS row_pos) FROM copies
)"""
)


@query(
    rounded(
        "kept", _CLEANED, _NUMBERS, _MARKET_FEEDS_SQL, DEDUP_SQL, _parsed("firsts", "parsed"), CLEAN_SQL,
        "kept AS (SELECT * FROM reasons WHERE reason IS NULL)",
    )
)
def clean_landed_in_steps(spark, folder):
    """Two batches landed and cleaned, a third for one market landed, what is new cleaned: as all of it at once."""
    path = scratch(spark)
    rows = feeds(spark, folder).withColumn("category", F.lit("all"))
    late = F.coalesce((F.col("store") == "Brand#11") & (F.col("city") == "City 0") & (F.col("product_id").cast("long") % 2 == 0), F.lit(False))
    early = F.col("row_pos") < 1000000000
    for batch in (~late & early, ~late & ~early, late):
        listing_io.append_raw_listings(rows.filter(batch), f"{path}/raw")
        jobs.clean_new_files(spark, f"{path}/raw", f"{path}/cleaned", f"{path}/seen")
    return listing_io.read_landed_cleaned(spark, f"{path}/cleaned").select(*_KEPT)


_GOLD_SQL = with_ctes(
    OFFERS,
    GOLD,
    select="""SELECT product_id, title, o.store AS store, o.city AS city, o.price AS price, o.unit_price AS unit_price,
              min_price, max_price, match_count, cluster_size FROM (SELECT *, unnest(offers) AS o FROM gold)""",
)


def _text_gold(spark: SparkSession, folder: str) -> DataFrame:
    return gold_view(spark, folder).withColumn("product_id", F.col("product_id").cast("string"))


def _gold_rows(gold: DataFrame) -> DataFrame:
    return gold.select(
        F.col("product_id").cast("long").alias("product_id"),
        "title",
        F.explode("offers").alias("o"),
        "min_price",
        "max_price",
        "match_count",
        "cluster_size",
    ).select(
        "product_id", "title", "o.store", "o.city", "o.price", "o.unit_price",
        "min_price", "max_price", "match_count", "cluster_size",
    )


def _gold_round_trip(fmt: str, read_as: str):
    def run(spark, folder):
        path = scratch(spark)
        gold_io.write_gold(_text_gold(spark, folder), path, fmt)
        return _gold_rows(gold_io.read_gold(spark, path, read_as))

    return run


for _name, _fmt, _read in [
    ("read_gold_lines", "json", "json"),
    ("read_gold_array", "json_array", "json"),
    ("write_gold", "parquet", "parquet"),
]:
    QUERIES[_name] = lambda spark, folder, f=_gold_round_trip(_fmt, _read): tidied(f(spark, folder))
    ORACLES[_name] = _GOLD_SQL


@query(
    with_ctes(
        OFFERS,
        GOLD,
        select="""SELECT CAST(product_id AS VARCHAR) AS product_id, title, brand, quantity, unit, category,
                  min_price, max_price, match_count FROM gold""",
    )
)
def flatten_gold(spark, folder):
    path = scratch(spark)
    gold_io.write_flat_gold(_text_gold(spark, folder), path)
    kinds = {"quantity": "double", "min_price": "double", "max_price": "double", "match_count": "long"}
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})


@query(rounded("scorecard", "store, city, wins", _SCORE, OFFERS, SCORECARD))
def read_metrics(spark, folder):
    path = scratch(spark)
    gold_io.write_metric_tables({"store_market_metrics": analytics.store_scorecard(market._offers(spark, folder, *market._FLAGGABLE))}, path)
    return gold_io.read_metrics(spark, f"{path}/store_market_metrics")


@query(with_ctes(OFFERS, market.DISPERSION, SCORECARD, CAT_LDI, select=market.METRICS_IN_LONG_FORM))
def write_metric_tables(spark, folder):
    path = scratch(spark)
    offers = market._offers(spark, folder, *market._FLAGGABLE)
    flagged = analytics.flag_lowest_once(offers)
    gold_io.write_metric_tables(
        {
            "product_dispersion_metrics": analytics.price_dispersion(offers),
            "store_market_metrics": analytics.store_scorecard(offers, flagged),
            "category_ldi_stats": analytics.category_dominance(flagged),
        },
        path,
    )
    measures = ", ".join(f"`{m}` double" for m in market._DISPERSION_COLUMNS)
    return market.metrics_in_long_form(
        {
            "product_dispersion_metrics": gold_io.read_metrics(
                spark, f"{path}/product_dispersion_metrics", f"product_id long, {measures}"
            ),
            "store_market_metrics": gold_io.read_metrics(spark, f"{path}/store_market_metrics"),
            "category_ldi_stats": gold_io.read_metrics(
                spark, f"{path}/category_ldi_stats", "category string, store string, cat_ldi double"
            ),
        }
    )


# --- the analysis job over gold: offers are the best ones ---

_BEST_OFFERS = (
    OFFERS.replace("offers AS", "all_offers AS", 1)
    + ","
    + BEST.replace("FROM offers", "FROM all_offers")
    + """,
offers AS (
  SELECT product_id, p_type AS category, store, city, o.price AS price, o.unit_price AS unit_price, first_ord AS ord
  FROM best JOIN part ON product_id = p_partkey
)"""
)


@query(with_ctes(_BEST_OFFERS, market.DISPERSION, SCORECARD, CAT_LDI, select=market.METRICS_IN_LONG_FORM))
def analyze_market(spark, folder):
    return market.metrics_in_long_form(jobs.analyze_market(materialise(_text_gold(spark, folder))))
