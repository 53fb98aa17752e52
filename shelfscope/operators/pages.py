"""Landed pages (page_id, url, html) to raw listings.

A page is read relationally.  Its html becomes rows of tags and texts, an
element is an opening tag with the place where it closes, and "the first
element inside a card that matches a selector" is the next matching row after
the card's own.  All steps work page by page, so the pages are spread by
page_id once and nothing is shuffled after that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import text
from shelfscope.schemas import RAW_FIELDS

PAGE = "page_id"

# --- Fixed values: html facts ---
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
UNNESTED_TAGS = ["p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "option", "dt", "dd"]
BLOCK_TAGS = ["address", "article", "aside", "br", "dd", "div", "dl", "dt", "fieldset", "footer", "form",
              "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre",
              "section", "table", "tr", "ul"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
            ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
TOKEN = r"(?s)</?[a-zA-Z][^>]*>|[^<]+|<"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# --- end of fixed values ---


@dataclass(frozen=True)
class Selector:
    """An element test: tag, part of the class, whole class word, contained text."""

    tag: str | None = None
    class_part: str | None = None
    class_word: str | None = None
    has_text: bool = False

    def matches(self) -> Column:
        tests = [F.col("opens")]
        if self.tag:
            tests.append(F.col("tag") == self.tag)
        if self.class_part:
            tests.append(F.col("css").contains(self.class_part))
        if self.class_word:
            tests.append(F.array_contains(F.split("css", r"\s+", -1), self.class_word))
        if self.has_text:
            tests.append(F.col("next_mark") < F.col("end"))
        return reduce(lambda a, b: a & b, tests)


def any_of(selectors: Sequence[Selector]) -> Column:
    return reduce(lambda a, b: a | b, [s.matches() for s in selectors])


@dataclass(frozen=True)
class CardRule:
    """How one store's product cards are found and read.

    ``containers`` are tried in order until one has more than ``min_hits``
    hits; the last one tried counts otherwise.  ``grammar`` ``decimal`` cuts
    the price out of the price element, ``whole`` looks for it in the card's
    text when the price element has no ``marker``.
    """

    site: str
    containers: Sequence[Sequence[Selector]]
    title: Sequence[Selector]
    price: Sequence[Selector]
    min_hits: int = 0
    min_title: int = 1
    marker: str | None = None
    grammar: str | None = None
    heading_fallback: bool = False
    secure_images: bool = False


# --- Fixed values: card rules of the three stores ---
LADDER_RULE = CardRule(
    site="https://shop.imtiaz.com.pk",
    containers=[
        [Selector("div", class_part="product_item")],
        [Selector("div", class_word="MuiGrid-item")],
        [Selector("div", class_part="hazle-")],
    ],
    min_hits=5,
    title=[Selector("h4"), Selector("div", class_part="title"), Selector("p", class_part="name")],
    min_title=3,
    price=[
        Selector("div", class_part="price_label"),
        Selector("p", has_text=True),
        Selector("div", has_text=True),
        Selector("span", has_text=True),
    ],
    marker="Rs.",
    grammar="decimal",
)
COMBINED_RULE = CardRule(
    site="https://www.metro-online.pk",
    containers=[
        [
            Selector("div", class_part="product_"),
            Selector("div", class_part="productCard"),
            Selector("div", class_part="nameAndPricing"),
        ],
        [Selector("div", class_part="product")],
    ],
    title=[Selector(class_part="Name"), Selector(class_part="name"), Selector(class_part="title")],
    heading_fallback=True,
    price=[Selector(class_part="Price"), Selector(class_part="price"), Selector("p")],
    marker="Rs",
    grammar="whole",
)
PAIRED_RULE = CardRule(
    site="https://alfatah.pk",
    containers=[
        [
            Selector("div", class_part="product-item"),
            Selector("div", class_part="product-card"),
            Selector("a", class_part="product"),
            Selector("div", class_part="grid-product"),
        ]
    ],
    title=[
        Selector("div", class_part="title"),
        Selector("h3", class_part="title"),
        Selector("a", class_part="title"),
    ],
    price=[
        Selector("div", class_part="price"),
        Selector("span", class_part="price"),
        Selector("div", class_part="money"),
    ],
    secure_images=True,
)
EMBEDDED_LISTS = [
    "$.props.pageProps.initialState.products.list",
    "$.props.pageProps.data.products",
    "$.props.pageProps.category.products",
    "$.props.pageProps.section.products",
]
HEADINGS = [Selector(h) for h in ("h1", "h2", "h3", "h4", "h5")]
# --- end of fixed values ---

EXTRACTED = ["product_id", "raw_title", "raw_price", "brand", "availability", "product_url", "image_url"]


# --- tags, texts, elements ----------------------------------------------------


def _tag(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))


def _shown(token: Column) -> Column:
    """What a token contributes to the visible text."""
    words = F.regexp_replace(token, r"\s+", " ")
    for entity, char in ENTITIES:
        words = F.replace(words, F.lit(entity), F.lit(char))
    breaks = F.when(_tag(token).isin(*BLOCK_TAGS), F.lit("\n")).otherwise(F.lit(""))
    return F.when(_tag(token) != "", breaks).otherwise(words)


def _tidy(shown: Column) -> Column:
    """White space of a cut of visible text as a reader sees it."""
    return text.strip(F.regexp_replace(shown, r" *\n\s*", "\n"))


def _attribute(token: Column, name: str) -> Column:
    value = F.regexp_extract(token, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    value = F.regexp_replace(value, r"^[\"']|[\"']$", "")
    return F.replace(value, F.lit("&amp;"), F.lit("&"))


def _spread(pages: DataFrame) -> DataFrame:
    """Pages with their tokens, spread by page once for all later steps."""
    seen = F.regexp_replace("html", UNSEEN, "")
    return pages.select(PAGE, F.regexp_extract_all(seen, F.lit(TOKEN), F.lit(0)).alias("tokens")).repartition(PAGE)


def _page_text(spread: DataFrame) -> DataFrame:
    return spread.select(PAGE, F.array_join(F.transform("tokens", _shown), "").alias("page_text"))


def _elements(spread: DataFrame) -> DataFrame:
    """One row per tag or text with position, end, text offsets and attributes.

    ``start_at``/``end_at`` cut an element's text out of the page's text.
    """
    token = F.col("token")
    rows = spread.select(PAGE, F.posexplode("tokens").alias("pos", "token")).select(
        PAGE,
        "pos",
        _tag(token).alias("tag"),
        token.startswith("</").alias("closes"),
        F.when(_tag(token) == "", token.contains("Rs.")).otherwise(F.lit(False)).alias("marks"),
        F.length(_shown(token)).alias("width"),
        F.when(~token.startswith("</") & (_tag(token) != ""), token).alias("open_tag"),
    )
    in_page = Window.partitionBy(PAGE).orderBy("pos")
    whole_page = Window.partitionBy(PAGE)
    in_tag = Window.partitionBy(PAGE, "tag").orderBy("pos")
    in_level = Window.partitionBy(PAGE, "tag", "level").orderBy("pos")
    empty = F.col("tag").isin(*VOID_TAGS) | F.coalesce(F.col("open_tag").endswith("/>"), F.lit(False))
    unnested = F.col("tag").isin(*UNNESTED_TAGS)
    step = F.when(empty, 0).when(F.col("closes"), -1).otherwise(1)
    rows = (
        rows.withColumn("start_at", F.sum("width").over(in_page) - F.col("width"))
        .withColumn("last_pos", F.max("pos").over(whole_page) + 1)
        .withColumn("last_at", F.sum("width").over(whole_page))
        # An opening tag and the tag that closes it have the same level.
        .withColumn("level", F.sum(step).over(in_tag) + F.when(F.col("closes"), 1).otherwise(0))
    )

    def end(same_level: str, page_end: str) -> Column:
        nested = F.lead(same_level).over(in_level)
        plain = F.lead(same_level).over(in_tag)
        return F.when(empty, F.col(same_level)).otherwise(
            F.coalesce(F.when(unnested, plain).otherwise(nested), F.col(page_end))
        )

    rows = rows.withColumns({"end": end("pos", "last_pos"), "end_at": end("start_at", "last_at")})
    return rows.select(
        PAGE,
        "pos",
        "end",
        "start_at",
        "end_at",
        "tag",
        "marks",
        F.col("open_tag").isNotNull().alias("opens"),
        F.coalesce(_attribute(F.col("open_tag"), "class"), F.lit("")).alias("css"),
        F.coalesce(_attribute(F.col("open_tag"), "href"), F.lit("")).alias("href"),
        F.coalesce(_attribute(F.col("open_tag"), "src"), F.lit("")).alias("src"),
    )


def _cut(part: Column) -> Column:
    """Visible text of an element, NULL when the element is missing."""
    return _tidy(F.substring(F.col("page_text"), part["start_at"] + 1, part["end_at"] - part["start_at"]))


# --- listings -------------------------------------------------------------------


def extract_card_listings(pages: DataFrame, rule: CardRule) -> DataFrame:
    """Listings of a store's product cards: page_id, pos and the extracted columns."""
    spread = _spread(pages)
    ahead = Window.partitionBy(PAGE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)

    def following(test: Column, what: Column) -> Column:
        """``what`` of the nearest later row that passes the test."""
        return F.last(F.when(test, what), ignorenulls=True).over(ahead)

    rows = _elements(spread)
    rows = rows.withColumn("next_mark", following(F.col("marks"), F.col("pos")))

    wanted = {"title": any_of(rule.title), "price": any_of(rule.price),
              "heading": any_of(HEADINGS), "image": Selector("img").matches(),
              "link": Selector("a").matches()}
    steps = {f"step{i}": any_of(selectors) for i, selectors in enumerate(rule.containers)}
    rows = rows.withColumns({f"is_{k}": v for k, v in wanted.items()} | steps)
    rows = rows.filter(reduce(lambda a, b: a | b, [F.col(f"is_{k}") for k in wanted] + [F.col(s) for s in steps]))

    hits = {s: F.sum(F.col(s).cast("int")).over(Window.partitionBy(PAGE)) for s in steps}
    names = list(steps)
    is_card = F.col(names[-1])
    for s in reversed(names[:-1]):
        is_card = F.when(F.col(f"hits_{s}") > rule.min_hits, F.col(s)).otherwise(is_card)
    rows = rows.withColumns({f"hits_{s}": h for s, h in hits.items()})

    place = F.struct("pos", "start_at", "end_at", "href", "src")
    rows = rows.withColumns({k: following(F.col(f"is_{k}"), place) for k in wanted})
    cards = rows.filter(is_card)

    def inside(part: str) -> Column:
        return F.when(F.col(part)["pos"] < F.col("end"), F.col(part)).alias(part)

    cards = cards.select(
        PAGE, "pos", F.struct("start_at", "end_at").alias("card"), *[inside(k) for k in wanted]
    )
    # One list of cards per page meets the page's text once.
    per_page = cards.groupBy(PAGE).agg(F.collect_list(F.struct("pos", "card", *wanted)).alias("cards"))
    read = per_page.join(_page_text(spread), PAGE).select(PAGE, "page_text", F.explode("cards").alias("c"))
    read = read.select(PAGE, "page_text", "c.*")

    title = F.coalesce(_cut(F.col("title")), F.lit(""))
    if rule.heading_fallback:
        title = F.when(title == "", F.coalesce(_cut(F.col("heading")), F.lit(""))).otherwise(title)
    price = F.coalesce(_cut(F.col("price")), F.lit(""))
    listings = read.select(
        PAGE,
        "pos",
        F.col("title").isNotNull().alias("has_title"),
        F.col("price").isNotNull().alias("has_price"),
        title.alias("raw_title"),
        price.alias("price_seen"),
        _cut(F.col("card")).alias("card_text"),
        F.coalesce(F.col("link")["href"], F.lit("")).alias("href"),
        F.coalesce(F.col("image")["src"], F.lit("")).alias("src"),
    )
    raw_price = F.col("price_seen")
    if rule.grammar == "decimal":
        listings = listings.filter(raw_price.contains(rule.marker))
        raw_price = text.price_text(raw_price, "decimal")
    elif rule.grammar == "whole":
        found = F.coalesce(text.price_text(F.col("card_text"), "whole"), raw_price)
        raw_price = F.when(raw_price.contains(rule.marker), raw_price).otherwise(found)
        listings = listings.filter(raw_price.contains(rule.marker))
    else:
        listings = listings.filter(F.col("has_title") & F.col("has_price"))
    image = text.absolutize_image(F.col("src")) if rule.secure_images else F.col("src")
    return listings.filter(F.length("raw_title") >= rule.min_title).select(
        PAGE,
        "pos",
        F.lit("").alias("product_id"),
        "raw_title",
        raw_price.alias("raw_price"),
        F.lit(text.DEFAULT_BRAND).alias("brand"),
        F.lit("In Stock").alias("availability"),
        text.absolutize_url(F.col("href"), rule.site).alias("product_url"),
        image.alias("image_url"),
    )


def extract_embedded_listings(pages: DataFrame, site: str = LADDER_RULE.site) -> DataFrame:
    """Listings of the JSON state embedded in a page; works row by row."""
    island = F.regexp_extract("html", r'(?is)<script[^>]*\bid="__NEXT_DATA__"[^>]*>(.*?)</script\s*>', 1)

    def listed(path: str) -> Column:
        found = F.get_json_object("island", path)
        whole = F.when(found.startswith("["), F.from_json(found, "array<string>"))
        return F.coalesce(whole, F.array().cast("array<string>"))

    items = (
        pages.select(PAGE, island.alias("island"))
        .filter(F.col("island") != "")
        .select(PAGE, F.posexplode(F.concat(*[listed(p) for p in EMBEDDED_LISTS])).alias("pos", "item"))
        .filter(F.col("item").startswith("{"))
    )

    def field(path: str) -> Column:
        return F.get_json_object("item", "$." + path)

    def truthy(value: Column) -> Column:
        return F.when(~value.isin("", "false", "[]", "{}") & ~F.coalesce(value.try_cast("double") == 0, F.lit(False)), value)

    def named(value: Column) -> Column:
        return F.when(value != "", value)

    # A stated but empty brand stays empty; only a missing one gets the default.
    keys = F.json_object_keys("item")
    flat_brand = F.when(F.array_contains(keys, "brand_name"), F.coalesce(field("brand_name"), F.lit(""))).otherwise(
        F.lit(text.DEFAULT_BRAND)
    )
    brand = F.when(field("brand").startswith("{"), F.coalesce(field("brand.name"), F.lit(""))).otherwise(flat_brand)
    title = text.strip(F.coalesce(named(field("name")), named(field("title"))))
    price = F.coalesce(truthy(field("price")), truthy(field("sale_price")))
    listings = items.select(
        PAGE,
        "pos",
        F.coalesce(field("id"), F.lit("")).alias("product_id"),
        title.alias("raw_title"),
        F.concat(F.lit("Rs. "), price).alias("raw_price"),
        brand.alias("brand"),
        F.when(field("status").try_cast("double") == 1, F.lit("In Stock"))
        .otherwise(F.lit("Out of Stock"))
        .alias("availability"),
        text.product_url_from_slug(field("slug"), site).alias("product_url"),
        F.coalesce(named(field("thumbnail")), field("image"), F.lit("")).alias("image_url"),
    ).filter((F.col("raw_title") != "") & F.col("raw_price").isNotNull())
    return _first_per_title(listings, F.col("pos"))


def _first_per_title(listings: DataFrame, *order: Column) -> DataFrame:
    turn = Window.partitionBy(PAGE, "raw_title").orderBy(*order)
    return listings.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") == 1).drop("_turn")


def merge_extractions(embedded: DataFrame, cards: DataFrame) -> DataFrame:
    """Embedded listings, then cards with titles not seen yet on the page."""
    both = embedded.withColumn("source", F.lit(0)).unionByName(cards.withColumn("source", F.lit(1)))
    return _first_per_title(both, F.col("source"), F.col("pos")).drop("source")


def assemble_raw_listing(extracted: DataFrame, store: Column, city: Column, category: Column) -> DataFrame:
    """The 12 raw columns: market, split category path, defaults for missing fields."""

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in extracted.columns else default

    columns = {
        "store": store,
        "city": city,
        "product_id": given("product_id", F.lit("")),
        "name": text.strip(given("raw_title", F.lit(""))),
        "brand": given("brand", F.lit(text.DEFAULT_BRAND)),
        "category": text.category_part(category),
        "subcategory": text.subcategory_part(category),
        "price": given("raw_price", F.lit("")),
        "availability": given("availability", F.lit("In Stock")),
        "product_url": given("product_url", F.lit("")),
        "image_url": given("image_url", F.lit("")),
        "timestamp": given(
            "scrape_timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        ),
    }
    return extracted.select(*[columns[c].alias(c) for c in RAW_FIELDS])


# --- categories -----------------------------------------------------------------


def anchors(pages: DataFrame) -> DataFrame:
    """Links of each page: page_id, pos, href and the first line of their text."""
    spread = _spread(pages)
    found = _elements(spread).filter((F.col("tag") == "a") & F.col("opens"))
    per_page = found.groupBy(PAGE).agg(
        F.collect_list(F.struct("pos", "href", F.struct("start_at", "end_at").alias("at"))).alias("links")
    )
    read = per_page.join(_page_text(spread), PAGE).select(PAGE, "page_text", F.inline("links"))
    return read.select(PAGE, "pos", "href", F.split(_cut(F.col("at")), "\n", -1)[0].alias("label"))


def discover_leaf_categories(
    pages: DataFrame,
    home_url: str | Column,
    site: str,
    marker: str = "/catalog/",
    top_depth: int = 2,
    sub_depth: int = 3,
) -> DataFrame:
    """(name, url) of leaf categories: subcategories as ``top > sub``, tops without any as they are.

    ``home_url`` is the start page's url, or a test over the pages.
    """
    link = F.col("href")
    steps = F.size(F.split(F.trim(link, F.lit("/")), "/", -1))
    target = F.concat(F.lit(site + "/"), F.ltrim(link, F.lit("/")))
    links = anchors(pages).filter(link.contains(marker) & (F.col("label") != ""))
    links = links.select(PAGE, "pos", "label", steps.alias("depth"), target.alias("target"))
    is_home = (F.col("url") == home_url) if isinstance(home_url, str) else home_url
    urls = pages.select(PAGE, "url", is_home.alias("is_home"))

    def last_url(rows: DataFrame, *by: str) -> DataFrame:
        """The url seen last under each name; combines before the shuffle."""
        latest = F.max(F.struct(PAGE, "pos", "target"))
        return rows.groupBy(*by).agg(latest.alias("l")).select(*by, F.col("l.target").alias("category_url"))

    home = links.filter(F.col("depth") == top_depth).join(urls.filter("is_home").select(PAGE), PAGE, "left_semi")
    tops = last_url(home.withColumnRenamed("label", "top"), "top")
    below = links.filter(F.col("depth") == sub_depth).join(urls.select(PAGE, "url"), PAGE)
    subs = below.join(tops, F.col("url") == F.col("category_url")).drop("category_url")
    subs = subs.withColumn("name", F.concat_ws(" > ", "top", "label"))
    leaves = last_url(subs, "top", "name")
    bare = tops.join(leaves.select("top"), "top", "left_anti").select(F.col("top").alias("name"), "category_url")
    return leaves.select("name", "category_url").unionByName(bare).select("name", F.col("category_url").alias("url"))
