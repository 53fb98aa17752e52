"""Cards, embedded JSON and links on small hand-written pages."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from shelfscope.operators import pages as P


def pages(spark, *bodies):
    rows = [(i, f"https://shop.example/{i}", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def read(df, *columns):
    return [tuple(r) for r in df.orderBy("page_id", "pos").select(*columns).collect()]


def ladder_card(n, title, price, css="product_item"):
    return f'<div class="{css}"><a href="/p/{n}"><img src="/i/{n}"></a><h4>{title}</h4><p>{price}</p></div>'


def test_ladder_takes_the_first_container_with_enough_hits(spark):
    many = "".join(ladder_card(i, f"Item {i}", f"Rs. {i}.50 <s>Rs. 9</s>") for i in range(6))
    few = ladder_card(1, "Lone item", "Rs. 5") + ladder_card(2, "Last resort", "Rs. 6", "hazle-x")
    got = read(P.extract_card_listings(pages(spark, many, few), P.LADDER_RULE), "page_id", "raw_title", "raw_price", "product_url")
    assert got[:2] == [
        (0, "Item 0", "Rs. 0.50", "https://shop.imtiaz.com.pk/p/0"),
        (0, "Item 1", "Rs. 1.50", "https://shop.imtiaz.com.pk/p/1"),
    ]
    assert len(got) == 7
    assert got[-1] == (1, "Last resort", "Rs. 6", "https://shop.imtiaz.com.pk/p/2")


def test_ladder_skips_short_titles_and_unpriced_cards(spark):
    body = "".join(ladder_card(i, t, p) for i, (t, p) in enumerate([("ab", "Rs. 1"), ("abc", "free"), ("abcd", "Rs. 2")] * 3))
    got = read(P.extract_card_listings(pages(spark, body), P.LADDER_RULE), "raw_title", "raw_price")
    assert got == [("abcd", "Rs. 2")] * 3


def test_combined_rule_falls_back_for_name_price_and_container(spark):
    body = (
        '<div class="my_product_1"><span class="itemName">Salt<br>800g</span><b>Rs 55</b></div>'
        '<div class="my_product_2"><h3>Oil &amp; Ghee</h3><p>Rs. 1,200</p><p>other</div>'
        '<div class="my_product_3"><h3>No price</h3></div>'
    )
    generic = '<div class="product"><div class="title">Tea</div><div class="price">Rs.9</div></div>'
    got = read(P.extract_card_listings(pages(spark, body, generic), P.COMBINED_RULE), "page_id", "raw_title", "raw_price")
    assert got == [(0, "Salt\n800g", "Rs 55"), (0, "Oil & Ghee", "Rs. 1,200"), (1, "Tea", "Rs.9")]


def test_paired_rule_needs_both_elements(spark):
    body = (
        '<div class="product-card"><h3 class="title"> Soap </h3><span class="price">Rs. 5</span><img src="//c/1.png"></div>'
        '<div class="product-card"><h3 class="title">Alone</h3></div>'
        '<div class="box"><h3 class="title">Outside</h3><span class="price">Rs. 7</span></div>'
    )
    got = read(P.extract_card_listings(pages(spark, body), P.PAIRED_RULE), "raw_title", "raw_price", "image_url")
    assert got == [("Soap", "Rs. 5", "https://c/1.png")]


def test_broken_markup_does_not_leak_between_cards(spark):
    body = "<p>a<p>b<!-- <div class='product-card'> --><script>var t='<div>';</script>" + "".join(
        f'<div class="product-card"><div class="title">T{i}</div><p>x<b>y<div class="price">Rs. {i}</div></div>' for i in range(3)
    )
    got = read(P.extract_card_listings(pages(spark, body), P.PAIRED_RULE), "raw_title", "raw_price")
    assert got == [("T0", "Rs. 0"), ("T1", "Rs. 1"), ("T2", "Rs. 2")]


def island(**lists):
    data = {"props": {"pageProps": lists}}
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'


def test_embedded_listings(spark):
    items = [
        {"id": 7, "name": " Tea ", "price": 120, "slug": "tea", "brand": {"name": "Tapal"}, "status": 1, "image": "/a"},
        {"title": "Salt", "price": 0, "sale_price": 50.5, "brand_name": "National", "status": 0},
        {"name": "Tea", "price": 1},
        {"name": "No price"},
        {"name": "Plain", "price": "30", "brand": {"name": None}},
        "text",
    ]
    html = island(data={"products": items}, category={"products": {"not": "a list"}}) + "<p>x"
    got = read(
        P.extract_embedded_listings(pages(spark, html, "<p>none")),
        "product_id", "raw_title", "raw_price", "brand", "availability", "product_url", "image_url",
    )
    assert got == [
        ("7", "Tea", "Rs. 120", "Tapal", "In Stock", "https://shop.imtiaz.com.pk/product/tea", "/a"),
        ("", "Salt", "Rs. 50.5", "National", "Out of Stock", "", ""),
        ("", "Plain", "Rs. 30", "", "Out of Stock", "", ""),
    ]


def test_embedded_listings_come_before_cards(spark):
    html = island(section={"products": [{"name": "Item 1", "price": 3}]}) + "".join(
        ladder_card(i, f"Item {i}", f"Rs. {i}") for i in [1, 2, 2, 3, 4, 5, 6]
    )
    frame = pages(spark, html)
    both = P.merge_extractions(P.extract_embedded_listings(frame), P.extract_card_listings(frame, P.LADDER_RULE))
    got = {(r["raw_title"], r["raw_price"]) for r in both.collect()}
    assert got == {("Item 1", "Rs. 3")} | {(f"Item {i}", f"Rs. {i}") for i in range(2, 7)}
    assert both.count() == 6


def test_raw_listing(spark):
    extracted = spark.createDataFrame([(" Tea\n", "Rs. 5", None)], "raw_title string, raw_price string, brand string")
    row = P.assemble_raw_listing(extracted, F.lit("S"), F.lit("X"), F.lit("Food > Drinks")).first()
    assert (row["name"], row["brand"], row["category"], row["subcategory"]) == ("Tea", "Generic", "Food", "Drinks")
    assert row["availability"] == "In Stock"
    assert row["timestamp"]


def test_leaf_categories(spark):
    home = '<a href="/catalog/a-1">Food<br>all</a><a href="/catalog/b-2">Care</a><a href="/about">About</a><a href="/catalog/a-9"><b>Food</b></a>'
    rows = [
        (0, "https://s/", home),
        (1, "https://s/catalog/a-9", '<a href="/catalog/a/rice-3">Rice</a><a href="/catalog/b-2">Care</a>'),
        (2, "https://s/catalog/b-2", "<p>nothing"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["name"], r["url"]) for r in P.discover_leaf_categories(frame, "https://s/", "https://s").collect()}
    assert got == {("Food > Rice", "https://s/catalog/a/rice-3"), ("Care", "https://s/catalog/b-2")}
