"""Clusters against the sequential definition; products from clusters."""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfscope.functions.similarity import lcs_lengths
from shelfscope.operators import matching as M

SCHEMA = (
    "ord long, name string, brand string, category string, quantity double, unit string, "
    "price double, unit_price double, store string, city string, timestamp string"
)


@cache
def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        previous = row[:]
        for j, y in enumerate(b):
            row[j + 1] = previous[j] + 1 if x == y else max(row[j], previous[j + 1])
    return row[-1]


def similar(a: str, b: str, threshold: int, method: str) -> bool:
    if method == "token_sort":
        return 200 * lcs(a, b) >= threshold * (len(a) + len(b))
    x, y = set(a.split()), set(b.split())
    return bool(x and y) and 100 * len(x & y) >= threshold * len(x | y)


def sequential(rows, threshold: int, method: str) -> dict[int, int]:
    leaders: dict[str, list] = {}
    out = {}
    for order, block, form in sorted(rows):
        here = leaders.setdefault(block, [])
        hit = next((o for o, f in here if similar(form, f, threshold, method)), None)
        if hit is None:
            here.append((order, form))
        out[order] = order if hit is None else hit
    return out


def random_forms(seed: int, n: int) -> list[tuple[int, str, str]]:
    """Forms with many near copies, one block far larger than the others."""
    rng = random.Random(seed)
    words = ["rice", "basmati", "super", "kernel", "soap", "lux", "rose", "tea", "oil", "max", "c12", "a"]
    stems = [" ".join(sorted(rng.sample(words, rng.randint(1, 4)))) for _ in range(8)]
    rows = []
    for order in range(n):
        form = rng.choice(stems)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(form) + 1)
            form = form[:at] + rng.choice("abcx1 ") + form[at + rng.randint(0, 1) :]
        block = rng.choice(["hot", "hot", "hot", "cold", "cool"])
        rows.append((order, block, " ".join(sorted(form.split()))))
    return rows


def clusters(spark, rows, threshold, method, heads):
    if method == "jaccard":
        rows = [(o, b, " ".join(sorted(set(f.split())))) for o, b, f in rows if f]
    frame = spark.createDataFrame(rows, "ord long, block_category string, form string").withColumns(
        {"block_quantity": F.lit(1.0), "block_unit": F.lit("kg")}
    )
    got = M.assign_leaders(frame, threshold, method, heads).select("ord", "leader").collect()
    return {r["ord"]: r["leader"] for r in got}, sequential(rows, threshold, method)


@pytest.mark.parametrize(
    ("seed", "method", "threshold", "heads"),
    [
        (1, "token_sort", 85, 256),
        (2, "token_sort", 85, 2),
        (3, "token_sort", 70, 3),
        (4, "token_sort", 60, 256),
        (5, "jaccard", 50, 2),
        (6, "jaccard", 85, 256),
    ],
)
def test_clusters_equal_the_sequential_ones(spark, seed, method, threshold, heads):
    got, want = clusters(spark, random_forms(seed, 150), threshold, method, heads)
    assert got == want


@pytest.mark.parametrize("threshold", [30, 50, 60, 80])
def test_words_of_one_title_alone_do_not_multiply_the_forms(spark, monkeypatch, threshold):
    rng = random.Random(threshold)
    stems = ["rice", "rice red", "rice red old", "tea", "tea old", "tea red old hot", "oil hot old red big"]
    rows = [
        (o, rng.choice(["hot", "cold"]), " ".join(sorted([*rng.choice(stems).split(), *[f"w{o}x{i}" for i in range(rng.randint(0, 2))]])))
        for o in range(400)
    ]
    filed = []
    file = M._file
    monkeypatch.setattr(M, "_file", lambda forms, *more: filed.append(forms.count()) or file(forms, *more))
    got, want = clusters(spark, rows, threshold, "jaccard", 8)
    assert got == want
    # Seven stems in two blocks with up to two words more; the kinds that are not alike among themselves stay apart.
    apart = {(o, b, f) for o, b, f in rows if not similar(f, " ".join(w if w[0] != "w" else w + "y" for w in f.split()), threshold, "jaccard")}
    assert len(filed) == 1 and filed[0] <= len(apart) + 42


def test_a_small_block_is_one_file(spark):
    forms = [(o, b, q, f) for o, (b, q, f) in enumerate((b, q, f) for b in ("rice", None) for q in (1.0, None) for f in ("red rice super", "red rice supr", "tea"))]
    frame = spark.createDataFrame(forms, "ord long, block_category string, block_quantity double, form string").withColumn("block_unit", F.lit("kg"))
    filed, _ = M._file(frame, 85, "token_sort")
    assert filed.count() == len(forms)
    assert filed.select("file").distinct().count() <= 4
    found = {(p["early"], p["late"]) for p in M.similar_titles(frame, 85).collect()}
    assert found == {(o, o + 1) for o in (0, 3, 6, 9)}


@pytest.mark.parametrize("small", [0, 6, 64])
@pytest.mark.parametrize(("threshold", "heads"), [(85, 2), (60, 256)])
def test_small_and_large_blocks_side_by_side(spark, monkeypatch, small, threshold, heads):
    monkeypatch.setattr(M, "SMALL_BLOCK", small)
    rows = random_forms(21, 120)
    rows += [(1000 + i, f"b{i % 9}", f) for i, (_, _, f) in enumerate(random_forms(22, 60))]
    got, want = clusters(spark, rows, threshold, "token_sort", heads)
    assert got == want


def test_no_similar_pair_is_missed(spark):
    rows = [(o, "b", f) for o, _, f in random_forms(9, 120)]
    distinct = {}
    for order, _, form in rows:
        distinct.setdefault(form, order)
    frame = spark.createDataFrame(rows, "ord long, block_category string, form string").withColumns(
        {"block_quantity": F.lit(1.0), "block_unit": F.lit("kg")}
    )
    for threshold in (90, 85, 70, 50):
        got = {(r["early"], r["late"]) for r in M.similar_titles(frame, threshold).collect()}
        forms = sorted((o, f) for f, o in distinct.items())
        want = {
            (o, p)
            for i, (o, f) in enumerate(forms)
            for p, g in forms[i + 1 :]
            if f and g and similar(f, g, threshold, "token_sort")
        }
        assert got == want, threshold


def test_subsequence_lengths():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd é") for _ in range(n)) for n in [0, 1, 5, 20, 63, 64, 65, 90, 200]]
    pairs = [(a, b) for a in texts for b in texts]
    got = lcs_lengths(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert got.tolist() == [lcs(a, b) for a, b in pairs]
    assert isinstance(got, np.ndarray)


def listing(order, name, price, store, city, category="Rice", quantity=1.0, unit="kg", brand="Generic"):
    return (order, name, brand, category, quantity, unit, price, price, store, city, f"t{order}")


def test_products(spark):
    rows = [
        listing(1, "Ponam Basmati Rice", 300.0, "A", "X", brand="Ponam"),
        listing(2, "Rice Basmati Ponam", 250.0, "B", "X"),
        listing(3, "Basmati Rice Ponam", 280.0, "A", "X"),
        listing(4, "Basmati Rice Ponam", 280.0, "A", "X", category="RICE"),
        listing(5, "Ponam Basmati Rice", 100.0, "A", "X", quantity=2.0),
        listing(6, "نمک", 10.0, "A", "X"),
        listing(7, "چینی", 11.0, "A", "Y"),
    ]
    gold = M.resolve_entities(spark.createDataFrame(rows, SCHEMA)).collect()
    by_title = {(g["title"], g["quantity"]): g for g in gold}
    assert len(gold) == 3
    rice = by_title[("Ponam Basmati Rice", 1.0)]
    assert (rice["brand"], rice["match_count"], rice["cluster_size"]) == ("Ponam", 2, 4)
    assert [(o["store"], o["price"], o["timestamp"]) for o in rice["offers"]] == [("A", 280.0, "t3"), ("B", 250.0, "t2")]
    assert (rice["min_price"], rice["max_price"]) == (250.0, 280.0)
    assert by_title[("نمک", 1.0)]["cluster_size"] == 2

    apart = M.resolve_entities(spark.createDataFrame(rows, SCHEMA), 85, "jaccard").collect()
    assert len(apart) == 4
    assert len({g["product_id"] for g in apart}) == 4


def test_result_does_not_depend_on_partitions(spark):
    rows = [
        listing(o, f, 10.0 + o, "S" + str(o % 3), "C", category=b) for o, b, f in random_forms(11, 80)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    one, many = (
        sorted(
            (g["product_id"], g["title"], g["cluster_size"], str(g["offers"]))
            for g in M.resolve_entities(frame.repartition(n)).collect()
        )
        for n in (1, 7)
    )
    assert one == many
    assert sum(row[2] for row in one) == len(rows)


SYLLABLES = [a + b for a in "bdklmnprst" for b in "aei"]


@pytest.mark.parametrize("kind", ["letters", "syllables"])
def test_few_pairs_of_unlike_titles_are_compared(spark, kind):
    """The pairs of a block that reach the similarity itself stay few a title, also where a vocabulary repeats its parts."""
    rng = random.Random(5)
    make = {
        "letters": lambda: "".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(3, 9))),
        "syllables": lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))),
    }[kind]
    words = [make() for _ in range(2000)]
    for n in (500, 2000):
        forms = sorted({" ".join(sorted(rng.sample(words, rng.randint(3, 6)))) for _ in range(n)})
        rows = [("c", 1.0, "u", form, i) for i, form in enumerate(forms)]
        frame = spark.createDataFrame(rows, "block_category string, block_quantity double, block_unit string, form string, ord long")
        filed, facts = M._file(frame, 85, "token_sort")
        met = M._candidates(filed, filed, facts, "token_sort", 85).count()
        assert met <= 0.0008 * len(forms) * (len(forms) - 1) / 2
        assert met <= 2 * len(forms)


def test_what_differs_in_place_only(spark):
    """Forms of the same grams in other places, with grams that repeat, and of one or two characters."""
    forms = ["abab abab", "abababab", "baba baba", "ab ab ab ab", "a", "b", "aa", "ab", "ba", "aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaaa", "aab", "aabb"]
    forms += ["abc def ghi", "def abc ghi", "ghi abc def", "abc def gh", "bc def ghi", "abc xdef ghi", "abcdefghi"]
    rows = [(i, "b", form) for i, form in enumerate(forms)]
    for threshold in (90, 85, 75, 60, 40):
        got, want = clusters(spark, rows, threshold, "token_sort", 256)
        assert got == want, threshold
