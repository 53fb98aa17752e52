"""Row filters, copies and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope.operators import cleaning as C
from shelfscope.schemas import CLEANED_FIELDS, RAW_LISTING


def raw(spark, rows):
    """Rows of (file, position, name, price, store) as raw listings."""
    frame = spark.createDataFrame(rows, "file_name string, row_pos long, name string, price string, store string")
    empty = {f.name: F.lit("") for f in RAW_LISTING.fields if f.name not in frame.columns}
    return frame.withColumns(empty).withColumn("city", F.lit("X"))


def test_first_copy_stays(spark):
    rows = [("f", 3, "a", "Rs. 5", "S"), ("f", 1, "a", "Rs. 5", "S"), ("f", 2, "a", "Rs. 6", "S"), ("g", 9, "a", "Rs. 5", "S")]
    kept = C.dedup_first(raw(spark, rows)).select("file_name", "row_pos").collect()
    assert sorted(map(tuple, kept)) == [("f", 1), ("f", 2), ("g", 9)]


def test_prices_are_parsed_after_copies_are_dropped(spark):
    """No parsing of prices in the part of the plan that reads every copy; copies with missing fields are copies too."""
    rows = [("f", 3, "a 2kg", "Rs. 50", "S"), ("f", 1, "a 2kg", "Rs. 50", "S"), ("f", 2, "a 2kg", None, "S"), ("f", 0, "a 2kg", None, "S")]
    rows += [(None, 8, None, "Rs. 7", "S"), (None, 7, None, "Rs. 7", "S"), ("f", 4, "a 2kg", "", "S"), ("f", 5, "", "Rs. 50", "S")]
    firsts = C.dedup_first(raw(spark, rows))
    assert sorted(r["row_pos"] for r in firsts.collect()) == [0, 1, 4, 5, 7]
    parsed = C.sane_unit_price(C.require_fields(C.normalize_listing(firsts)))
    assert [r["row_pos"] for r in parsed.collect()] == [1]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    behind, before = plan.rsplit("Window [", 1)
    assert "regexp" in behind
    assert "regexp" not in before


def test_columns_and_defaults(spark):
    out = C.normalize_listing(raw(spark, [("f", 1, "Lux Soap 100g", "Rs. 50", "S")]).drop("availability").withColumn("availability", F.lit(None).cast("string")))
    assert out.columns == ["file_name", "row_pos", *CLEANED_FIELDS]
    row = out.first()
    assert (row["brand"], row["quantity"], row["unit"], row["unit_price"]) == ("Lux", 0.1, "kg", 500.0)
    assert row["availability"] == "In Stock"


def test_row_filters(spark):
    rows = [
        ("f", 1, "ok", "Rs. 50", "S"),
        ("f", 2, "", "Rs. 50", "S"),
        ("f", 3, "free", "Rs. 0", "S"),
        ("f", 4, "nowhere", "Rs. 50", ""),
        ("f", 5, "unpriced", "", "S"),
        ("f", 6, "one", "Rs. 1", "S"),
        ("f", 7, "dear", "Rs. 100,000", "S"),
        ("f", 8, "no size 1,000g", "Rs. 50", "S"),
    ]
    parsed = C.sane_unit_price(C.require_fields(C.normalize_listing(raw(spark, rows))))
    assert [r["row_pos"] for r in parsed.collect()] == [1]


def test_outliers_per_feed_and_category(spark):
    prices = [100, 101, 102, 103, 104, 105, 900]
    rows = [("f", i, f"n{i}", f"Rs. {p}", "S") for i, p in enumerate(prices)]
    rows += [("few", i, f"n{i}", f"Rs. {p}", "S") for i, p in enumerate([10, 11, 12, 9000])]
    rows += [("same", i, f"n{i}", "Rs. 7", "S") for i in range(6)]
    parsed = C.normalize_listing(raw(spark, rows))
    kept = C.category_outlier_filter(parsed)
    dropped = C.outlier_audit(parsed).collect()
    assert kept.count() == 6 + 4 + 6
    assert [(d["file_name"], d["price"], d["reason"]) for d in dropped] == [("f", 900.0, "iqr")]
