"""Readers, writers and the stream of raw files."""

from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.plans import jobs
from shelfscope.sources import catalogue
from shelfscope.sources import gold as G
from shelfscope.sources import listings as L
from shelfscope.schemas import CLEANED_FIELDS, GOLD, RAW_FIELDS
from shelfscope.streaming import feed

HEADER = ",".join(RAW_FIELDS)
LINES = [
    'Metro,Lahore,,"Tomatoes 250GM\n\nRs. 55",Generic,Grocery,,"Rs. 1,049.00",In Stock,,,2025-01-02T03:04:05.678901',
    'Metro,Lahore,,"Say ""cheese""",Generic,Grocery,,Rs. 5,In Stock,,,2025-01-02T03:04:06.678901',
]


def raw_folder(tmp_path, name="Metro_Lahore.csv", lines=LINES):
    folder = tmp_path / "raw"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    (folder / "notes.txt").write_text("not a listing")
    return str(folder)


def test_raw_files(spark, tmp_path):
    rows = L.read_raw_listings(spark, raw_folder(tmp_path)).orderBy("row_pos").collect()
    assert [r["name"] for r in rows] == ["Tomatoes 250GM\n\nRs. 55", 'Say "cheese"']
    assert rows[0]["subcategory"] == ""
    assert {r["file_name"] for r in rows} == {"Metro_Lahore.csv"}


def test_cleaned_files(spark, tmp_path):
    folder = raw_folder(tmp_path)
    cleaned = jobs.clean_listings(L.read_raw_listings(spark, folder))
    out = str(tmp_path / "processed")
    L.write_cleaned(cleaned, out)
    back = spark.read.parquet(out)
    assert sorted(r["price"] for r in back.collect()) == [5.0, 1049.0]
    assert "PartitionFilters: [isnotnull(store" in _plan(back.filter("store = 'Metro'"))

    named = tmp_path / "csv"
    named.mkdir()
    text = "name,price,quantity\nTea,12.5,x\n"
    head = "product_id,name,brand,category,subcategory,price,quantity,unit,unit_price,availability,store,city,product_url,image_url,scrape_timestamp,processed_timestamp"
    (named / "A_cleaned.csv").write_text(f"{head}\n,Tea,Tapal,Drinks,,12.5,bad,kg,,In Stock,S,X,,,2025-01-02T03:04:05.678901,\n")
    (named / "B.csv").write_text(text)
    row = L.read_cleaned_listings(spark, str(named)).collect()
    assert [(r["name"], r["price"], r["quantity"], r["subcategory"]) for r in row] == [("Tea", 12.5, None, "")]
    assert row[0]["scrape_timestamp"].microsecond == 678901


def test_columns_go_by_name(spark, tmp_path):
    """Files of one folder in different orders, with missing and with other columns, one of them with a byte-order mark."""
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("city,store,name,price\nLahore,Metro,Rice 1kg,Rs. 50\n")
    (folder / "b.csv").write_text('\ufeffname,colour,store,price,city\n"Tea, ""green""\n500g",red,Metro,Rs. 60,Multan\nSalt,blue,Metro,,Multan\n')
    (folder / "c.csv").write_text(",".join(RAW_FIELDS) + "\n")
    for multi_line in (True, False):
        rows = L.read_raw_listings(spark, str(folder), multi_line).orderBy("file_name", "row_pos").collect()
        assert (rows[0]["store"], rows[0]["city"], rows[0]["name"], rows[0]["price"], rows[0]["category"]) == ("Metro", "Lahore", "Rice 1kg", "Rs. 50", "")
        if multi_line:
            assert [(r["name"], r["price"], r["city"]) for r in rows[1:]] == [('Tea, "green"\n500g', "Rs. 60", "Multan"), ("Salt", "", "Multan")]
    feed.land_raw_feed(feed.raw_feed(spark, str(folder)), str(tmp_path / "landed"), str(tmp_path / "state")).awaitTermination(120)
    landed = {(r["name"], r["price"], r["store"], r["city"]) for r in L.read_landed_listings(spark, str(tmp_path / "landed")).collect()}
    assert landed == {("Rice 1kg", "Rs. 50", "Metro", "Lahore"), ('Tea, "green"\n500g', "Rs. 60", "Metro", "Multan"), ("Salt", "", "Metro", "Multan")}


def test_any_number_of_columns(spark, tmp_path):
    """Known columns behind hundreds of others, some with quoted commas; files of other widths beside it."""
    folder = tmp_path / "wide"
    folder.mkdir()
    others = [f'"o,{i}"' for i in range(300)]
    wide = [",".join([*others, "store", "name", "price"]), ",".join(["x"] * 300 + ["Metro", '"Tea, green"', "Rs. 5"])]
    (folder / "wide.csv").write_text("\n".join(wide) + "\n")
    (folder / "narrow.csv").write_text("name,store\nRice,Metro\n")
    (folder / "empty.csv").write_text("")
    rows = L.read_raw_listings(spark, str(folder)).select("store", "name", "price").collect()
    assert sorted(map(tuple, rows)) == [("Metro", "Rice", ""), ("Metro", "Tea, green", "Rs. 5")]
    (folder / "split.csv").write_text('name,"a\nb",store\nRice,x,Shop\n')
    rows = L.read_raw_listings(spark, str(folder)).filter("store = 'Shop'").collect()
    assert [r["name"] for r in rows] == ["Rice"]


@pytest.mark.parametrize("seed", range(2))
def test_records_over_lines_and_blocks(spark, tmp_path, seed):
    """Files cut into blocks of 300 bytes, inside cells and between quotes, give what a sequential reader gives."""
    pick = random.Random(seed)
    folder = tmp_path / "cut"
    folder.mkdir()
    want = []
    for name in ("a.csv", "b.csv", "c.csv"):
        cell = lambda: "".join(pick.choice(['"', ",", "\n", "x", "yz", " ", "\r\n", ""]) for _ in range(pick.randrange(12)))
        rows = [[cell(), "Metro", cell(), pick.choice(["5", 'say "five"'])] for _ in range(60)]
        with open(folder / name, "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator=pick.choice(["\n", "\r\n"])).writerows([["name", "store", "other, too", "price"], *rows])
        want += [(name, r[0], r[3]) for r in rows]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
        lines = L._lines(spark, str(folder), "*.csv")
        assert lines.select("_path", "_block").distinct().count() > 9
        rows = L.read_raw_listings(spark, str(folder)).orderBy("file_name", "row_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [(r["file_name"], r["name"], r["price"]) for r in rows] == want


def test_a_quote_that_is_text(spark, tmp_path):
    """A quote inside a cell without quotes opens nothing; blank lines and a mark before a quoted head are no data."""
    folder = tmp_path / "inch"
    folder.mkdir()
    (folder / "a.csv").write_text('\ufeff"name",store,price\n\nPipe 5",Metro,1\n"Rod\n3""",Metro,2\nTape 2" wide,Metro,3\n\n', encoding="utf-8")
    rows = L.read_raw_listings(spark, str(folder)).orderBy("row_pos").collect()
    assert [(r["name"], r["price"]) for r in rows] == [('Pipe 5"', "1"), ('Rod\n3"', "2"), ('Tape 2" wide', "3")]


def test_landed_cleaned_listings_keep_their_order(spark, tmp_path):
    lines = [f"Metro,Lahore,,Rice {i} 1kg,Generic,Grocery,,Rs. {i + 10},In Stock,,,2026-01-01T00:00:00" for i in range(12)]
    folder = raw_folder(tmp_path, lines=lines)
    cleaned = jobs.clean_listings(L.read_raw_listings(spark, folder))
    want = [r["name"] for r in cleaned.orderBy("file_name", "row_pos").collect()]
    for fmt in ("parquet", "csv"):
        out = str(tmp_path / fmt)
        L.write_cleaned(cleaned, out, fmt)
        back = L.read_landed_cleaned(spark, out, fmt)
        rows = back.orderBy("file_name", "row_pos").collect()
        assert [r["name"] for r in rows] == want and {r["file_name"] for r in rows} == {"Metro_Lahore.csv"}
        assert [r["price"] for r in rows] == [float(i + 10) for i in range(12)]


def test_older_listings_are_matched_too(spark, tmp_path):
    jobs.clean_folder(spark, raw_folder(tmp_path), str(tmp_path / "processed"))
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.jsonl").write_text(json.dumps({"title": "Tea", "price": 5.0, "quantity": 1.0, "unit": "kg", "store": "S", "city": "X", "category": "Drinks"}) + "\n")
    jobs.match_folder(spark, str(tmp_path / "processed"), str(tmp_path / "gold"), legacy_folder=str(tmp_path / "old"))
    assert G.read_gold(spark, str(tmp_path / "gold"), "parquet").count() == 3
    jobs.analyze_folder(spark, str(tmp_path / "gold"), str(tmp_path / "reports"))
    assert G.read_metrics(spark, str(tmp_path / "reports/store_market_metrics")).count() == 2


def test_intermediate_tables_go_with_their_job(spark):
    import os

    from shelfscope import session

    def tables():
        return set(os.listdir(session.shared_folder(spark)))

    outer = session.materialise(spark.range(3))
    before = tables()
    with pytest.raises(ZeroDivisionError), session.intermediates(spark):
        session.materialise(spark.range(5))
        assert len(tables()) == len(before) + 1
        raise ZeroDivisionError
    assert tables() == before and outer.count() == 3


def test_a_folder_of_lines_and_arrays(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text("\n  " + json.dumps([PRODUCT, PRODUCT], indent=2))
    (tmp_path / "g" / "b.json").write_text(json.dumps(PRODUCT) + "\n")
    gold = G.read_gold(spark, str(tmp_path / "g"))
    assert [r["offers"][0]["price"] for r in gold.collect()] == [5.0] * 3


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_nothing_is_written_when_empty(spark, tmp_path):
    empty = L.read_raw_listings(spark, raw_folder(tmp_path, lines=[]))
    L.append_raw_listings(empty, str(tmp_path / "landed"))
    L.write_cleaned(jobs.clean_listings(empty), str(tmp_path / "cleaned"))
    assert not (tmp_path / "landed").exists()
    assert not (tmp_path / "cleaned").exists()


def test_legacy_form_joins_the_present_one(spark, tmp_path):
    (tmp_path / "old.jsonl").write_text(json.dumps({"title": "Tea", "price": 5.0, "quantity": 1.0, "unit": "kg", "store": "S", "city": "X", "category": "Drinks"}) + "\n")
    old = L.read_legacy_cleaned(spark, str(tmp_path / "old.jsonl"))
    cleaned = jobs.clean_listings(L.read_raw_listings(spark, raw_folder(tmp_path)))
    both = L.union_listings(cleaned, old)
    assert both.count() == 3
    assert jobs.match_listings(both).count() == 3


PRODUCT = {"product_id": "1", "title": "Tea", "offers": [{"store": "S", "city": "X", "price": 5.0}], "min_price": 5.0, "match_count": 1}


def test_gold_lines_and_array(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text(json.dumps(PRODUCT) + "\n" + json.dumps(PRODUCT) + "\n")
    (tmp_path / "array.json").write_text("\n  " + json.dumps([PRODUCT, PRODUCT], indent=2))
    for name in ("lines.jsonl", "array.json"):
        gold = G.read_gold(spark, str(tmp_path / name))
        assert gold.schema == GOLD
        assert [r["offers"][0]["price"] for r in gold.collect()] == [5.0, 5.0]


def test_gold_array_is_valid_json(spark, tmp_path):
    gold = G.read_gold(spark, _lines(tmp_path)).repartition(2)
    G.write_gold(gold, str(tmp_path / "out"), "json_array")
    parts = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*") if p.read_text()]
    assert sum(map(len, parts)) == 5
    assert G.read_gold(spark, str(tmp_path / "out")).count() == 5


def _lines(tmp_path) -> str:
    path = tmp_path / "five.jsonl"
    path.write_text("".join(json.dumps(PRODUCT | {"product_id": str(i)}) + "\n" for i in range(5)))
    return str(path)


def test_metrics_may_be_absent(spark, tmp_path):
    assert G.read_metrics(spark, str(tmp_path / "none")) is None
    table = spark.createDataFrame([("S", "X", 1.0, None, 2.0, 0.5, 3.0, 1.0, 4)], G.STORE_METRICS)
    G.write_metric_tables({"m": table}, str(tmp_path))
    back = G.read_metrics(spark, str(tmp_path / "m")).collect()
    assert back[0]["price_volatility_score"] is None
    assert back[0]["wins"] == 4


def test_catalogue(spark):
    rows = catalogue.source_catalogue(spark)
    assert rows.count() == 2 * 9 + 2 * 8 + 2
    assert rows.filter(F.col("url").isNull()).count() == 2


def test_feed_lands_new_files_once(spark, tmp_path):
    folder = raw_folder(tmp_path)
    landed, state = str(tmp_path / "landed"), str(tmp_path / "state")
    for expected in (2, 2):
        feed.land_raw_feed(feed.raw_feed(spark, folder), landed, state).awaitTermination(120)
        assert L.read_landed_listings(spark, landed).count() == expected
    raw_folder(tmp_path, "Metro_Lahore_2.csv", LINES[:1])
    feed.land_raw_feed(feed.raw_feed(spark, folder), landed, state).awaitTermination(120)
    rows = L.read_landed_listings(spark, landed)
    assert rows.count() == 3
    assert jobs.clean_listings(rows).count() == 2


def test_folders_in_folders_out(spark, tmp_path):
    jobs.run_on_folders(spark, raw_folder(tmp_path), str(tmp_path / "out"))
    assert G.read_gold(spark, str(tmp_path / "out/matched/products"), "parquet").count() == 2
    assert G.read_metrics(spark, str(tmp_path / "out/reports/store_market_metrics")).count() == 1


def test_only_changed_markets_are_cleaned_again(spark, tmp_path):
    raw, cleaned, seen = (str(tmp_path / name) for name in ("raw", "cleaned", "seen"))

    def land(city, prices):
        rows = [("Metro", city, "", f"Rice of {city}, {p}, 1kg", "Generic", "Grocery", "", f"Rs. {p}", "In Stock", "", "", "2026-01-01T00:00:00") for p in prices]
        by_name = dict(zip(HEADER.split(","), range(len(RAW_FIELDS))))
        L.append_raw_listings(spark.createDataFrame([[r[by_name[f]] for f in RAW_FIELDS] for r in rows], ", ".join(f"`{f}` string" for f in RAW_FIELDS)), raw)
        jobs.clean_new_files(spark, raw, cleaned, seen)

    def files(city):
        return {p.name for p in (tmp_path / "cleaned" / "store=Metro" / f"city={city}").glob("*.parquet")}

    def same_as_at_once():
        names = [f for f in CLEANED_FIELDS if f != "processed_timestamp"]
        want = jobs.clean_listings(L.read_landed_listings(spark, raw)).select(*names).collect()
        got = L.read_landed_cleaned(spark, cleaned).select(*names).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))

    land("Lahore", [50, 51, 52, 53, 900])
    land("Multan", [50, 51, 52, 53, 54])
    before = files("Lahore"), files("Multan")
    same_as_at_once()
    assert L.read_landed_cleaned(spark, cleaned).count() == 9
    land("Lahore", [800, 850, 950, 990])  # the dear price is no outlier any more
    assert files("Multan") == before[1] and not files("Lahore") & before[0]
    same_as_at_once()
    assert L.read_landed_cleaned(spark, cleaned).count() == 14
    jobs.clean_new_files(spark, raw, cleaned, seen)
    assert files("Multan") == before[1]
