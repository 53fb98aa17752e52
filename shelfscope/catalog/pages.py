"""Queries over pages: links of the landed pages, and store pages built from the parts.

The landed pages hold no shop listings, so the listing queries lay the parts
out as shop pages of twelve cards each, in the layout of each store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.catalog.common import LISTINGS, cents, tidied, with_ctes
from shelfscope.functions import text
from shelfscope.operators import pages as P
from shelfscope.plans.views import listing_view, table
from shelfscope.schemas import RAW_FIELDS
from shelfscope.sources import catalogue

QUERIES, ORACLES = {}, {}
PER_PAGE = 12


def query(sql: str | None):
    """Register a function of (spark, folder) under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: tidied(f(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _laid_out(spark: SparkSession, folder: str, card: F.Column, head: F.Column | None = None) -> DataFrame:
    """Shop pages (page_id, url, html) with one card per part."""
    part = table(spark, folder, "part").withColumn("page_id", F.floor(F.col("p_partkey") / PER_PAGE))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda c: c["card"]), "\n")
    head = F.lit("") if head is None else head
    return (
        part.withColumn("card", card)
        .groupBy("page_id")
        .agg(body.alias("body"), *([head.alias("head")]))
        .select(
            "page_id",
            F.concat(F.lit("https://shop.example/"), F.col("page_id").cast("string")).alias("url"),
            F.concat(
                F.lit("<html><head><title>Shop</title><style>.a{b:c}</style></head><body><!-- <div class='product_item'> -->"),
                "head",
                F.lit("<p>Offers<p>of the day<br><div class=\"list\">"),
                "body",
                F.lit("</div></body></html>"),
            ).alias("html"),
        )
    )


def _price(k: float = 1.0) -> F.Column:
    return F.format_string("%.2f", F.round(F.col("p_retailprice") * k, 2))


def _sql_price(k: float = 1.0) -> str:
    return f"printf('%.2f', {cents(f'p_retailprice * {k}')})" if k != 1.0 else "printf('%.2f', p_retailprice)"



def _key() -> F.Column:
    return F.col("p_partkey").cast("string")


_OUT = "page_id, raw_title, raw_price, brand, availability, product_url, image_url"


def _out(df: DataFrame) -> DataFrame:
    return df.select(*_OUT.split(", "))


# One card in three has no price and one in seven a title that is too short.
def _ladder_card() -> F.Column:
    return F.concat(
        F.lit('<div class="hazle-card big"><a href="/p/'), _key(), F.lit('"><img src="/i/'), _key(),
        F.lit('.jpg"></a><h4 class="x">'),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("ab")).otherwise(F.concat("p_name", F.lit(" &amp; co "), _key())),
        F.lit('</h4><div class="row"><span>'),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("sold out")).otherwise(F.concat(F.lit("Rs. "), _price(), F.lit(" Rs. "), _price(0.9))),
        F.lit("</span></div></div>"),
    )


@query(
    f"""SELECT p_partkey // 12 AS page_id, p_name || ' & co ' || p_partkey AS raw_title,
        'Rs. ' || {_sql_price()} AS raw_price, 'Generic' AS brand, 'In Stock' AS availability,
        'https://shop.imtiaz.com.pk/p/' || p_partkey AS product_url, '/i/' || p_partkey || '.jpg' AS image_url
        FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0"""
)
def extract_cards_by_ladder(spark, folder):
    return _out(P.extract_card_listings(_laid_out(spark, folder, _ladder_card()), P.LADDER_RULE))


# Nested card parts, names in headings for some, prices only in the card's text for others.
def _combined_card() -> F.Column:
    return F.concat(
        F.lit('<div class="CategoryGrid_product_card"><img src="https://cdn/'), _key(), F.lit('.png"/><div><a href="'),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("/d/")).otherwise(F.lit("https://www.metro-online.pk/d/")), _key(),
        F.lit('">see</a>'),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("<h3> "), "p_name", F.lit("</h3>"))).otherwise(
            F.concat(F.lit('<span class="CategoryGrid_itemName__1">'), "p_name", F.lit("</span>"))
        ),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('<p class="old">was more</p><b>Rs.'), _price(), F.lit("</b>"))).otherwise(
            F.concat(F.lit('<p class="Price__2">Rs. '), _price(), F.lit("</p>"))
        ),
        F.lit("</div></div>"),
    )


@query(
    f"""SELECT p_partkey // 12 AS page_id, p_name AS raw_title,
        CASE WHEN p_partkey % 4 = 0 THEN regexp_extract('Rs.' || {_sql_price()}, 'Rs\\.\\d+')
             ELSE 'Rs. ' || {_sql_price()} END AS raw_price,
        'Generic' AS brand, 'In Stock' AS availability,
        'https://www.metro-online.pk/d/' || p_partkey AS product_url,
        'https://cdn/' || p_partkey || '.png' AS image_url FROM part"""
)
def extract_cards_by_combination(spark, folder):
    return _out(P.extract_card_listings(_laid_out(spark, folder, _combined_card()), P.COMBINED_RULE))


def _paired_card() -> F.Column:
    return F.concat(
        F.lit('<div class="grid-product"><div class="pic"><img src="//cdn/'), _key(), F.lit('.png"></div>'),
        F.lit('<h3 class="p_title">'), F.col("p_name"), F.lit("</h3>"),
        F.when(F.col("p_partkey") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("<span class='price-now'>Rs."), _price(), F.lit("</span>"))),
        F.lit('<a href="/x/'), _key(), F.lit('">more</a></div>'),
    )


@query(
    f"""SELECT p_partkey // 12 AS page_id, p_name AS raw_title, 'Rs.' || {_sql_price()} AS raw_price,
        'Generic' AS brand, 'In Stock' AS availability, 'https://alfatah.pk/x/' || p_partkey AS product_url,
        'https://cdn/' || p_partkey || '.png' AS image_url FROM part WHERE p_partkey % 6 <> 0"""
)
def extract_cards_in_pairs(spark, folder):
    return _out(P.extract_card_listings(_laid_out(spark, folder, _paired_card()), P.PAIRED_RULE))


# Parts in the page's JSON: some under another path, with another title or price key, some without price.
def _item() -> F.Column:
    return F.to_json(
        F.struct(
            F.col("p_partkey").alias("id"),
            F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), _key())).alias("name"),
            F.concat("p_name", F.lit(" "), _key()).alias("title"),
            F.when(F.col("p_partkey") % 5 == 0, F.lit(0)).otherwise(F.col("p_size")).alias("price"),
            F.when(F.col("p_partkey") % 10 != 0, F.lit(7)).alias("sale_price"),
            F.concat(F.lit("s-"), _key()).alias("slug"),
            F.when(F.col("p_partkey") % 3 == 0, F.struct(F.col("p_brand").alias("name"))).alias("brand"),
            F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("own "), "p_brand")).alias("brand_name"),
            F.when(F.col("p_partkey") % 4 == 0, F.lit(1)).otherwise(F.lit(0)).alias("status"),
            F.lit("").alias("thumbnail"),
            F.concat(F.lit("/t/"), _key()).alias("image"),
        )
    )


def _island() -> F.Column:
    """The JSON island with even keys in one product list and odd ones in another."""
    items = F.array_sort(F.collect_list(F.struct("p_partkey", _item().alias("item"))))

    def listed(rest: int) -> F.Column:
        mine = F.filter(items, lambda x: x["p_partkey"] % 2 == rest)
        return F.concat(F.lit("["), F.array_join(F.transform(mine, lambda x: x["item"]), ","), F.lit("]"))

    return F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"products":'),
        listed(1),
        F.lit('},"section":{"products":'),
        listed(0),
        F.lit('},"category":{"products":{"none":1}}}}}</script>'),
    )


_EMBEDDED_SQL = """
embedded AS (
  SELECT p_partkey // 12 AS page_id, CAST(p_partkey AS VARCHAR) AS product_id, p_name || ' ' || p_partkey AS raw_title,
         'Rs. ' || CASE WHEN p_partkey % 5 = 0 THEN 7 ELSE p_size END AS raw_price,
         CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'own ' || p_brand ELSE 'Generic' END AS brand,
         CASE WHEN p_partkey % 4 = 0 THEN 'In Stock' ELSE 'Out of Stock' END AS availability,
         'https://shop.imtiaz.com.pk/product/s-' || p_partkey AS product_url, '/t/' || p_partkey AS image_url
  FROM part WHERE p_partkey % 10 <> 0
)"""


@query(with_ctes(_EMBEDDED_SQL, select=f"SELECT product_id, {_OUT} FROM embedded"))
def extract_embedded_listings(spark, folder):
    pages = _laid_out(spark, folder, F.lit(""), _island())
    return P.extract_embedded_listings(pages).select("product_id", *_OUT.split(", "))


# The same parts again as cards, and the title of each under the name in the JSON.
def _card_again() -> F.Column:
    return F.concat(
        F.lit('<div class="product_item"><h4>'), F.col("p_name"), F.lit(" "), _key(),
        F.lit("</h4><p>Rs. 5</p></div>"),
    )


@query(
    with_ctes(
        _EMBEDDED_SQL,
        select="""SELECT page_id, raw_title, raw_price, brand, availability, product_url FROM embedded
                  UNION ALL
                  SELECT p_partkey // 12, p_name || ' ' || p_partkey, 'Rs. 5', 'Generic', 'In Stock', ''
                  FROM part WHERE p_partkey % 10 = 0
                  AND p_partkey // 12 IN (SELECT p_partkey // 12 FROM part GROUP BY 1 HAVING count(*) > 5)""",
    )
)
def merge_extractions(spark, folder):
    pages = _laid_out(spark, folder, _card_again(), _island())
    both = P.merge_extractions(P.extract_embedded_listings(pages), P.extract_card_listings(pages, P.LADDER_RULE))
    return both.select("page_id", "raw_title", "raw_price", "brand", "availability", "product_url").filter(
        F.col("page_id").isNotNull()
    )


@query(
    with_ctes(
        LISTINGS,
        select=r"""SELECT product_id, regexp_extract(price, 'Rs\.\s*[\d,.]+') AS with_decimals,
                   nullif(regexp_extract(price, 'Rs\.?\s*[\d,]+'), '') AS whole, name AS unmatched FROM listings""",
    )
)
def price_text(spark, folder):
    return listing_view(spark, folder).select(
        "product_id",
        text.price_text(F.col("price"), "decimal").alias("with_decimals"),
        text.price_text(F.col("price"), "whole").alias("whole"),
        text.price_text(F.col("name"), "decimal").alias("unmatched"),
    )


# --- links of the landed pages ---

_SEEN = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"
_LINKS = rf"""
links AS (
  SELECT page_id, url, unnest(regexp_extract_all({_SEEN}, '<a href="([^"]*)"', 1)) AS href,
         unnest(regexp_extract_all({_SEEN}, '<a href="[^"]*">([^<]*)', 1)) AS label,
         unnest(range(1, len(regexp_extract_all({_SEEN}, '<a href="([^"]*)"', 1)) + 1)) AS pos
  FROM pages
)"""


@query(with_ctes(_LINKS, select="SELECT page_id, replace(href, '&amp;', '&') AS href, count(*) AS n FROM links GROUP BY ALL"))
def page_links(spark, folder):
    return P.anchors(table(spark, folder, "pages")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_ctes(
        _LINKS,
        select="""SELECT page_id, replace(href, '&amp;', '&') AS href, count(*) AS n,
                  CASE WHEN href = '' THEN '' WHEN starts_with(href, 'http') THEN replace(href, '&amp;', '&')
                       ELSE 'https://shop.example' || replace(href, '&amp;', '&') END AS url,
                  CASE WHEN href = '' THEN '' ELSE 'https:/' || replace(href, '&amp;', '&') END AS image
                  FROM links GROUP BY ALL""",
    )
)
def absolutize_url(spark, folder):
    links = P.anchors(table(spark, folder, "pages"))
    image = text.absolutize_image(F.when(F.col("href") == "", F.lit("")).otherwise(F.concat(F.lit("/"), "href")))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n")).select(
        "page_id", "href", "n", text.absolutize_url(F.col("href"), "https://shop.example").alias("url"), image.alias("image")
    )


@query(
    with_ctes(
        _LINKS,
        select="""SELECT trim(label) AS name,
                  arg_max('https://shop.example/' || ltrim(replace(href, '&amp;', '&'), '/'), (page_id, pos)) AS url
                  FROM links WHERE trim(label) <> '' AND contains(href, '/') AND len(string_split(trim(href, '/'), '/')) = 1
                  GROUP BY 1""",
    )
)
def discover_top_categories(spark, folder):
    return P.discover_leaf_categories(
        table(spark, folder, "pages"), F.lit(True), "https://shop.example", marker="/", top_depth=1, sub_depth=2
    )


# Brands as top categories on the start page; each brand's page links its types,
# but for brands whose number is a multiple of five.
_SHOP = "https://shop.example"


def _category_pages(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        "p_brand", "p_type", F.translate("p_brand", "#", "-").alias("slug"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("nr")
    )

    def page(links: F.Column) -> F.Column:
        return F.concat(F.lit("<body><a href='/about'>About</a>"), F.array_join(F.array_sort(F.collect_set(links)), ""), F.lit("</body>"))

    top = F.concat(F.lit("<a href='/catalog/"), "slug", F.lit("'>"), "p_brand", F.lit("<br>new</a>"))
    sub = F.concat(F.lit("<a href='/catalog/"), "slug", F.lit("/"), "p_type", F.lit("'>"), "p_type", F.lit("</a>"))
    home = part.agg(F.lit(0).cast("long").alias("page_id"), F.lit(_SHOP + "/").alias("url"), page(top).alias("html"))
    tops = part.groupBy("nr", "slug").agg(page(F.when(F.col("nr") % 5 != 0, sub)).alias("html"))
    return home.unionByName(
        tops.select(F.col("nr").cast("long").alias("page_id"), F.concat(F.lit(_SHOP + "/catalog/"), "slug").alias("url"), "html")
    )


@query(
    """SELECT DISTINCT CASE WHEN nr % 5 <> 0 THEN p_brand || ' > ' || p_type ELSE p_brand END AS name,
       'https://shop.example/catalog/' || replace(p_brand, '#', '-') ||
         CASE WHEN nr % 5 <> 0 THEN '/' || p_type ELSE '' END AS url
       FROM (SELECT *, CAST(regexp_extract(p_brand, '\\d+') AS INT) AS nr FROM part)"""
)
def discover_leaf_categories(spark, folder):
    return P.discover_leaf_categories(_category_pages(spark, folder), _SHOP + "/", _SHOP)


# --- raw listings ---

_PATH_SQL = "CASE WHEN p_partkey % 2 = 0 THEN p_type || ' > ' || p_brand ELSE p_type END"


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" > ", "p_type", "p_brand")).otherwise(F.col("p_type"))
    return table(spark, folder, "part").withColumn("path", path)


@query(
    f"""SELECT p_partkey, p_type AS category, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS subcategory FROM part"""
)
def split_category_path(spark, folder):
    return _paths(spark, folder).select(
        "p_partkey",
        text.category_part(F.col("path")).alias("category"),
        text.subcategory_part(F.col("path")).alias("subcategory"),
    )


@query(
    f"""SELECT p_brand AS store, 'City' AS city, '' AS product_id, p_name AS name, 'Generic' AS brand, p_type AS category,
        CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS subcategory, 'Rs. ' || {_sql_price()} AS price,
        'In Stock' AS availability, '' AS product_url, '' AS image_url, CAST(p_partkey AS VARCHAR) AS "timestamp" FROM part"""
)
def assemble_raw_listing(spark, folder):
    extracted = _paths(spark, folder).select(
        F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("raw_title"),
        F.concat(F.lit("Rs. "), _price()).alias("raw_price"),
        _key().alias("scrape_timestamp"),
        "p_brand",
        "path",
    )
    return P.assemble_raw_listing(extracted, F.col("p_brand"), F.lit("City"), F.col("path")).select(*RAW_FIELDS)


def _values(rows: list[tuple[str, ...]], columns: str) -> str:
    return f"(VALUES {', '.join(map(str, rows))}) t({columns})"


# Parts dealt to the markets; how many products each market holds per known category page.
@query(
    f"""SELECT store, city, category, url, count(*) AS products
        FROM (SELECT {[s for s, _ in catalogue.MARKETS]!r}[CAST(p_partkey % 6 AS INT) + 1] AS store,
                     {[c for _, c in catalogue.MARKETS]!r}[CAST(p_partkey % 6 AS INT) + 1] AS city FROM part)
        JOIN {_values(catalogue.MARKETS, 'store, city')} USING (store, city)
        LEFT JOIN {_values(catalogue.CATEGORY_PAGES, 'store, category, url')} USING (store)
        GROUP BY ALL"""
)
def source_catalogue(spark, folder):
    deal = (F.col("p_partkey") % len(catalogue.MARKETS)).cast("int")
    stores, cities = (F.array(*[F.lit(m[i]) for m in catalogue.MARKETS]) for i in (0, 1))
    parts = table(spark, folder, "part").groupBy(stores[deal].alias("store"), cities[deal].alias("city")).agg(
        F.count(F.lit(1)).alias("products")
    )
    return parts.join(catalogue.source_catalogue(spark), ["store", "city"]).select(
        "store", "city", "category", "url", "products"
    )
