"""Queries over titles: normal forms, similarity, clusters, gold products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.catalog import market
from shelfscope.catalog.common import BEST, GOLD, LCS, OFFERS, cents, r, scratch, tidied, with_ctes
from shelfscope.catalog.listings import CLEAN_SQL, DEDUP_SQL, FEEDS_SQL, _parsed, feeds
from shelfscope.functions import similarity as S
from shelfscope.functions.text import normalize_title as normalized
from shelfscope.operators import matching as M
from shelfscope.plans import jobs
from shelfscope.plans.views import gold_view, listing_view, offers_view, table
from shelfscope.session import intermediates, materialise
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


TITLE_SQL = (
    r"trim(regexp_replace(regexp_replace(lower({0}), '\d+(\.\d+)?\s*(kg|g|gm|ml|l|liter|dozen|pcs|pieces)', '', 'g'),"
    r" '[^a-z0-9]+', ' ', 'g'))"
)
WORDS_SQL = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
FORM_SQL = {
    "token_sort": f"array_to_string(list_sort({WORDS_SQL}), ' ')",
    "jaccard": f"array_to_string(list_sort(list_distinct({WORDS_SQL})), ' ')",
}


@query(f"SELECT p_partkey, {TITLE_SQL.format('p_name || p_size || chr(39) || p_brand')} AS title FROM part")
def normalize_title(spark, folder):
    name = F.concat("p_name", F.col("p_size").cast("string"), F.lit("'"), "p_brand")
    return table(spark, folder, "part").select("p_partkey", normalized(name).alias("title"))


# Each part's title next to the title of the following part.
NEIGHBOURS = f"""
neighbours AS (
  SELECT a.p_partkey AS p_partkey, {FORM_SQL['token_sort'].format('a.p_name')} AS x,
         {FORM_SQL['token_sort'].format('b.p_name')} AS y
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
)"""
SCORED = f"""
scored AS (SELECT x, y, {LCS.format(a='x', b='y')} AS lcs FROM (SELECT DISTINCT x, y FROM neighbours))"""


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_partkey", S.sorted_tokens(normalized(F.col("p_name"))).alias("x"))
    following = names.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return names.join(following, "p_partkey")


@query(
    with_ctes(
        NEIGHBOURS,
        SCORED,
        select=f"""SELECT p_partkey, {r('200.0 * lcs / (length(x) + length(y))')} AS ratio
                   FROM neighbours JOIN scored USING (x, y)""",
    )
)
def token_sort_ratio(spark, folder):
    return _neighbours(spark, folder).select(
        "p_partkey", S.token_sort_ratio(F.col("x"), F.col("y")).alias("ratio")
    )


@query(
    with_ctes(
        NEIGHBOURS,
        select=f"""SELECT p_partkey, {r('''100.0 * len(list_intersect(string_split(x, ' '), string_split(y, ' ')))
                   / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' '))))''')} AS ratio
                   FROM neighbours""",
    )
)
def token_jaccard(spark, folder):
    return _neighbours(spark, folder).select("p_partkey", S.token_jaccard(F.col("x"), F.col("y")).alias("ratio"))


@query(
    """SELECT lower(p_type) AS block_category, CAST(p_size AS DOUBLE) AS block_quantity, 'unit' AS block_unit,
       count(*) AS rows FROM part GROUP BY ALL"""
)
def block_key(spark, folder):
    rows = M.block_key(_part_listings(spark, folder))
    return rows.groupBy(*M.BLOCK).agg(F.count(F.lit(1)).alias("rows"))


def _part_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as cleaned listings: type and size block them, brands are the stores."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("double").alias("quantity"),
        F.lit("unit").alias("unit"),
        F.col("p_retailprice").alias("price"),
        F.round(F.col("p_retailprice") / F.col("p_size"), 2).alias("unit_price"),
        F.col("p_brand").alias("store"),
        F.concat(F.lit("City "), (F.col("p_partkey") % 3).cast("string")).alias("city"),
        F.col("p_partkey").cast("string").alias("timestamp"),
    )


def _hit(method: str, threshold: int) -> str:
    if method == "jaccard":
        a, b = "string_split(x, ' ')", "string_split(y, ' ')"
        return f"100 * len(list_intersect({a}, {b})) >= {threshold} * len(list_distinct(list_concat({a}, {b})))"
    return f"200 * {LCS.format(a='x', b='y')} >= {threshold} * (length(x) + length(y))"


def walk(method: str, threshold: int) -> str:
    """The sequential definition: row by row in each block, against the leaders so far.

    Expects ``rows`` with ord, name, block_category, block_quantity, block_unit.
    """
    form = FORM_SQL[method].format(TITLE_SQL.format("name"))
    return f"""
formed AS (
  SELECT *, {form} AS form, struct_pack(c := block_category, q := block_quantity, u := block_unit) AS b,
         row_number() OVER (PARTITION BY block_category, block_quantity, block_unit ORDER BY ord) AS rk
  FROM rows
),
meeting AS (
  SELECT DISTINCT l.form AS x, r.form AS y FROM formed l JOIN formed r ON l.b = r.b
),
alike AS (SELECT x, y FROM meeting WHERE {_hit(method, threshold)}),
near AS (
  SELECT l.b, l.rk, any_value(l.ord) AS ord, coalesce(list(r.ord) FILTER (WHERE r.ord IS NOT NULL), []) AS before
  FROM formed l LEFT JOIN (formed r JOIN alike ON r.form = alike.x)
    ON l.b = r.b AND r.rk < l.rk AND l.form = alike.y
  GROUP BY l.b, l.rk
),
walk AS (
  SELECT b, rk, ord, ord AS leader, [ord] AS leaders FROM near WHERE rk = 1
  UNION ALL
  SELECT n.b, n.rk, n.ord,
         coalesce(list_filter(w.leaders, lambda k: list_contains(n.before, k))[1], n.ord),
         CASE WHEN len(list_filter(w.leaders, lambda k: list_contains(n.before, k))) = 0
              THEN list_append(w.leaders, n.ord) ELSE w.leaders END
  FROM walk w JOIN near n ON n.b = w.b AND n.rk = w.rk + 1
)"""


PART_ROWS = f"""
rows AS (
  SELECT p_partkey AS ord, p_name AS name, p_brand AS brand, p_type AS category, CAST(p_size AS DOUBLE) AS quantity,
         'unit' AS unit, p_retailprice AS price, {cents('p_retailprice / p_size')} AS unit_price,
         p_brand AS store, 'City ' || CAST(p_partkey % 3 AS VARCHAR) AS city,
         lower(p_type) AS block_category, CAST(p_size AS DOUBLE) AS block_quantity, 'unit' AS block_unit
  FROM part
)"""


def _clusters(spark: SparkSession, folder: str, method: str, threshold: int) -> DataFrame:
    rows = M.block_key(_part_listings(spark, folder)).withColumn("form", M.compared_form(F.col("name"), method))
    return M.assign_leaders(rows.select(*M.BLOCK, "form", "ord"), threshold, method).select("ord", "leader")


for _method, _threshold in [("token_sort", 85), ("token_sort", 70), ("jaccard", 50)]:
    _name = f"leader_clusters_{_method}_{_threshold}"
    QUERIES[_name] = lambda spark, folder, m=_method, t=_threshold: _clusters(spark, folder, m, t)
    ORACLES[_name] = with_ctes(
        PART_ROWS, walk(_method, _threshold), select="SELECT ord, leader FROM walk", recursive=True
    )

# Hundreds to thousands of different titles in one block: the type alone blocks, and a word made of the key is in each name.
_WORDY_ROWS = PART_ROWS.replace(
    "p_name AS name", "p_name || ' ' || p_brand || ' ' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'qwxzvkjybp') AS name"
).replace("CAST(p_size AS DOUBLE) AS block_quantity", "1.0 AS block_quantity")


@query(with_ctes(_WORDY_ROWS, walk("jaccard", 60), select="SELECT ord, leader FROM walk", recursive=True))
def leader_clusters_many_titles(spark, folder):
    word = F.translate(F.col("ord").cast("string"), "0123456789", "qwxzvkjybp")
    rows = _part_listings(spark, folder).withColumn("name", F.concat_ws(" ", "name", "brand", word))
    rows = M.block_key(rows).withColumn("block_quantity", F.lit(1.0))
    rows = rows.withColumn("form", M.compared_form(F.col("name"), "jaccard"))
    return M.assign_leaders(rows.select(*M.BLOCK, "form", "ord"), 60, "jaccard").select("ord", "leader")


SIMILAR_SQL = with_ctes(
    PART_ROWS,
    f"""forms AS (
      SELECT block_category AS c, block_quantity AS q, {FORM_SQL['token_sort'].format(TITLE_SQL.format('name'))} AS form,
             min(ord) AS ord FROM rows GROUP BY ALL
    ),
    meeting AS (SELECT DISTINCT l.form AS x, r.form AS y FROM forms l JOIN forms r ON l.c = r.c AND l.q = r.q AND l.ord < r.ord),
    alike AS (SELECT x, y FROM meeting WHERE {_hit('token_sort', 70)})""",
    select="""SELECT l.ord AS early, r.ord AS late FROM forms l JOIN forms r ON l.c = r.c AND l.q = r.q AND l.ord < r.ord
              JOIN alike ON alike.x = l.form AND alike.y = r.form""",
)


@query(SIMILAR_SQL)
def similar_titles(spark, folder):
    rows = M.block_key(_part_listings(spark, folder)).withColumn("form", M.compared_form(F.col("name"), "token_sort"))
    return M.similar_titles(rows.select(*M.BLOCK, "form", "ord"), 70)


# --- products ---

_GOLD_COLUMNS = ["title", "brand", "quantity", "unit", "category", "min_price", "max_price", "match_count", "cluster_size"]


def _flat(gold: DataFrame) -> DataFrame:
    """Gold with its offers spelled out in order, one text per product."""
    spelled = F.array_join(
        F.transform("offers", lambda o: F.concat_ws("@", F.format_string("%.2f", o["price"]), o["store"], o["city"])), ", "
    )
    return gold.select("product_id", *_GOLD_COLUMNS, spelled.alias("offers"))


def _spelled_in_full(gold: DataFrame) -> DataFrame:
    """As :func:`_flat`, with the unit price and the time of every offer."""
    spelled = F.array_join(
        F.transform(
            "offers",
            lambda o: F.concat_ws(
                "@", F.format_string("%.2f", o["price"]), F.format_string("%.2f", o["unit_price"]), o["timestamp"], o["store"], o["city"]
            ),
        ),
        ", ",
    )
    return gold.select("product_id", *_GOLD_COLUMNS, spelled.alias("offers"))


def resolved(method: str, threshold: int) -> str:
    """Gold products of ``rows`` (with name, brand, category, quantity, unit, price, store, city)."""
    return (
        walk(method, threshold)
        + """,
assigned AS (SELECT formed.*, leader FROM formed JOIN walk USING (b, ord)),
cells AS (
  SELECT b, leader, store, city, min(price) AS price, arg_min(unit_price, (price, ord)) AS unit_price,
         min(ord) AS first_ord, count(*) AS n
  FROM assigned GROUP BY b, leader, store, city
),
shortest AS (
  SELECT b, leader, arg_min(struct_pack(name := name, brand := brand, quantity := quantity, unit := unit,
                                        category := category), (length(name), ord)) AS s
  FROM assigned GROUP BY b, leader
),
products AS (
  SELECT sha256(b.c || '|' || CAST(b.q AS VARCHAR) || '|' || b.u || '|' || form) AS product_id,
         s.name AS title, s.brand AS brand, s.quantity AS quantity, s.unit AS unit, s.category AS category,
         min(price) AS min_price, max(price) AS max_price, count(*) AS match_count,
         CAST(sum(n) AS BIGINT) AS cluster_size,
         string_agg(printf('%.2f', price) || '@' || store || '@' || city, ', ' ORDER BY first_ord) AS offers,
         list(struct_pack(store := store, city := city, price := price, unit_price := unit_price)
              ORDER BY first_ord) AS offer_list
  FROM cells JOIN shortest USING (b, leader) JOIN (SELECT b, ord AS leader, form FROM formed) USING (b, leader)
  GROUP BY b, leader, form, s
)"""
    )


_PRODUCTS = "SELECT product_id, " + ", ".join(_GOLD_COLUMNS) + ", offers FROM products"


@query(with_ctes(PART_ROWS, resolved("token_sort", 85), select=_PRODUCTS, recursive=True))
def resolve_entities(spark, folder):
    return _flat(M.resolve_entities(_part_listings(spark, folder)))


@query(
    with_ctes(
        PART_ROWS,
        resolved("jaccard", 50).replace("|| form)", "|| form || '|{}')"),
        select=_PRODUCTS,
        recursive=True,
    )
)
def resolve_entities_by_words(spark, folder):
    return _flat(M.resolve_entities(_part_listings(spark, folder), 50, "jaccard"))


@query(
    """SELECT sha256(lower(p_type) || '|' || CAST(CAST(p_size AS DOUBLE) AS VARCHAR) || '|unit|' || p_name) AS product_id,
       p_partkey FROM part"""
)
def product_id(spark, folder):
    rows = M.block_key(_part_listings(spark, folder))
    return rows.select(
        M.product_id(*[F.col(c).cast("string") for c in M.BLOCK], F.col("name")).alias("product_id"),
        F.col("ord").alias("p_partkey"),
    )


@query(
    with_ctes(
        OFFERS,
        BEST,
        select="""SELECT product_id, store, city, o.price AS price, o.unit_price AS unit_price, o."timestamp" AS "timestamp", n AS rows FROM best""",
    )
)
def best_offer(spark, folder):
    cells = M.best_offer(offers_view(spark, folder).withColumn("name", F.col("title")), ["product_id"])
    return cells.select("product_id", "store", "city", "best.price", "best.unit_price", "best.timestamp", "rows")


# The shortest title among the parts of one brand and type stands for them.
@query(
    """SELECT category, brand, s.name AS title, s.quantity AS quantity FROM (
         SELECT p_type AS category, p_brand AS brand,
                arg_min(struct_pack(name := p_name, quantity := CAST(p_size AS DOUBLE)), (length(p_name), p_partkey)) AS s
         FROM part GROUP BY p_type, p_brand)"""
)
def canonical_item(spark, folder):
    rows = _part_listings(spark, folder).withColumns({"group_type": F.col("category"), "group_brand": F.col("brand")})
    return M.canonical_item(rows, ["group_type", "group_brand"]).select("category", "brand", "title", "quantity")


@query(
    with_ctes(
        OFFERS,
        GOLD,
        select="""SELECT product_id, title, brand, quantity, unit, category, min_price, max_price, match_count,
                  cluster_size, array_to_string(list_transform(offers,
                    lambda o: printf('%.2f', o.price) || '@' || printf('%.2f', o.unit_price) || '@' || o."timestamp"
                      || '@' || o.store || '@' || o.city), ', ') AS offers FROM gold""",
    )
)
def assemble_gold(spark, folder):
    return _spelled_in_full(gold_view(spark, folder))


# --- the matching job, and clean > match > analyse in a row ---

CLEANED_ROWS = """
cleaned AS (SELECT * FROM reasons WHERE reason IS NULL),
rows AS (
  SELECT row_number() OVER (ORDER BY file_name, row_pos) AS ord, name, brand, category, quantity, unit, price, unit_price,
         store, city, lower(category) AS block_category, quantity AS block_quantity, lower(unit) AS block_unit
  FROM cleaned
)"""
_CLEAN = (FEEDS_SQL, DEDUP_SQL, _parsed("firsts", "parsed"), CLEAN_SQL, CLEANED_ROWS)
_LISTED = "product_id, title, brand, unit, category, match_count, cluster_size, offers"


@query(
    with_ctes(
        *_CLEAN,
        resolved("token_sort", 85),
        select=f"SELECT {_LISTED}, {r('quantity')} AS quantity, min_price, max_price FROM products",
        recursive=True,
    )
)
def match_listings(spark, folder):
    return _flat(jobs.match_listings(jobs.clean_listings(feeds(spark, folder))))


def _through_files(fmt: str):
    """Clean, land, read back, match: the stages started from what the one before landed."""

    def run(spark, folder):
        cleaned, gold = scratch(spark), scratch(spark)
        with intermediates(spark):
            listing_io.write_cleaned(jobs.clean_listings(feeds(spark, folder)), cleaned, fmt)
        jobs.match_folder(spark, cleaned, gold, fmt)
        return tidied(_flat(gold_io.read_gold(spark, gold, "parquet")))

    return run


QUERIES |= {"match_landed_listings": _through_files("parquet"), "match_landed_csv": _through_files("csv")}
ORACLES |= dict.fromkeys(["match_landed_listings", "match_landed_csv"], ORACLES["match_listings"])


_GOLD_OFFERS = """
offers AS (
  SELECT product_id, category, o.store AS store, o.city AS city, o.price AS price, o.unit_price AS unit_price
  FROM (SELECT *, unnest(offer_list) AS o FROM products)
)"""


@query(
    with_ctes(
        *_CLEAN,
        resolved("token_sort", 85),
        _GOLD_OFFERS,
        market.DISPERSION,
        market.SCORECARD,
        market.CAT_LDI,
        select=market.METRICS_IN_LONG_FORM,
        recursive=True,
    )
)
def end_to_end(spark, folder):
    return market.metrics_in_long_form(jobs.end_to_end(feeds(spark, folder)))
