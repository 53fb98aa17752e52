"""Scalar expressions on strings that have gone wrong before."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import text


def evaluate(spark, expression, value):
    frame = spark.createDataFrame([(value,)], "s string")
    return frame.select(expression(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("value", "price"),
    [
        ("Rs. 159.00", 159.0),
        ("Rs. 50 Rs.60", 60.0),
        ("Rs. 1,095.00", 1095.0),
        ("Rs 1,049", 1049.0),
        ("Rs. ,", None),
        ("rs 5", None),
        ("", None),
        (None, None),
    ],
)
def test_clean_price(spark, value, price):
    assert evaluate(spark, text.clean_price, value) == price


@pytest.mark.parametrize(
    ("name", "quantity", "unit"),
    [
        ("Bananas per Dozen", 12.0, "pcs"),
        ("Eggs Per Doz 12kg", 12.0, "pcs"),
        ("Tyfon Bleach 1Ltr", 1.0, "L"),
        ("Beef Mince per 250gm", 0.25, "kg"),
        ("1,000g Rice", 0.0, "kg"),
        ("5 Gloves", 0.005, "kg"),
        ("12 Large Eggs", 12.0, "L"),
        ("Cotton Buds 100's Jar", 1.0, "unit"),
        ("Oil 2.5 Liters", 2.5, "L"),
        ("Soap 3 Pieces", 3.0, "pcs"),
        ("Salt 2doz", 24.0, "pcs"),
        ("", 1.0, "unit"),
    ],
)
def test_quantity(spark, name, quantity, unit):
    assert evaluate(spark, text.quantity_value, name) == pytest.approx(quantity)
    assert evaluate(spark, text.quantity_unit, name) == unit


@pytest.mark.parametrize(
    ("title", "form"),
    [
        ("Tyfon Bleach 1Ltr", "tyfon bleach tr"),
        ("Beef Mince per 250gm", "beef mince per m"),
        ("Surf-Excel, 2 liters!", "surf excel iters"),
        ("  ", ""),
        (None, ""),
        ("نمک", ""),
    ],
)
def test_normalize_title(spark, title, form):
    assert evaluate(spark, text.normalize_title, title) == form


@pytest.mark.parametrize(
    ("title", "brand"),
    [
        ("International Salt", "National"),
        ("luxury soap", "Lux"),
        ("Dalda by NESTLE", "Nestle"),
        ("Nestlé Milk", "Nestle"),
        ("\tShan Masala", "Shan"),
        ("", "Generic"),
    ],
)
def test_extract_brand(spark, title, brand):
    assert evaluate(spark, text.extract_brand, title) == brand


def test_stated_brand_is_kept(spark):
    frame = spark.createDataFrame([("Shan", "lux"), ("Generic", "lux"), ("", "lux"), (None, "lux")], "b string, t string")
    got = [r[0] for r in frame.select(text.resolve_brand(F.col("b"), F.col("t"))).collect()]
    assert got == ["Shan", "Lux", "Lux", "Lux"]


def test_unit_price_guards(spark):
    frame = spark.createDataFrame([(10.0, 4.0), (0.0, 4.0), (10.0, 0.0), (None, 1.0), (1.0, 3.0)], "p double, q double")
    got = [r[0] for r in frame.select(text.unit_price(F.col("p"), F.col("q"))).collect()]
    assert got == [2.5, None, None, None, 0.33]


@pytest.mark.parametrize(
    ("value", "decimal", "whole"),
    [
        ("Rs. 200.50\nRs. 300", "Rs. 200.50", "Rs. 200"),
        ("now Rs200", "now Rs200", "Rs200"),
        ("sold out", "sold out", None),
    ],
)
def test_price_text(spark, value, decimal, whole):
    assert evaluate(spark, text.price_text, value) == decimal
    assert evaluate(spark, lambda c: text.price_text(c, "whole"), value) == whole


def test_links(spark):
    base = "https://shop.example"
    assert evaluate(spark, lambda c: text.absolutize_url(c, base), "/a") == base + "/a"
    assert evaluate(spark, lambda c: text.absolutize_url(c, base), "http://x/a") == "http://x/a"
    assert evaluate(spark, lambda c: text.absolutize_url(c, base), "") == ""
    assert evaluate(spark, text.absolutize_image, "//cdn/a.png") == "https://cdn/a.png"
    assert evaluate(spark, text.absolutize_image, "/a.png") == "/a.png"


def test_category_path(spark):
    assert evaluate(spark, text.category_part, "Food > Rice > Old") == "Food"
    assert evaluate(spark, text.subcategory_part, "Food > Rice > Old") == "Rice"
    assert evaluate(spark, text.subcategory_part, "Food") == ""
