"""Grouped statistics against pandas and numpy, by rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfscope.functions import stats
from shelfscope.functions.stats import group_quantiles, safe_corr

PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0}


def sample() -> pd.DataFrame:
    rng = np.random.default_rng(7)
    sizes = {"hot": 900, "warm": 41, "pair": 2, "single": 1}
    rows = [(k, float(v)) for k, n in sizes.items() for v in np.round(rng.gamma(2.0, 50.0, n), 1)]
    return pd.DataFrame(rows, columns=["k", "v"])


@pytest.mark.parametrize("weighted", [False, True])
def test_quantiles(spark, weighted):
    rows = sample()
    frame = spark.createDataFrame(rows).unionByName(spark.createDataFrame([("warm", None), (None, 1.0)], "k string, v double"))
    weight = None
    if weighted:
        frame, weight = frame.groupBy("k", "v").count(), "count"
    got = group_quantiles(
        frame, ["k"], "v", PROBS, weight=weight, moments={"largest": F.max("v")}
    )
    got = got.toPandas().set_index("k")
    assert set(got.index) == set(rows.k)
    for k, group in rows.groupby("k"):
        want = [group.v.quantile(p) for p in PROBS.values()] + [group.v.max()]
        assert got.loc[k].tolist() == pytest.approx(want), k


def test_correlation_of_a_constant_is_null(spark):
    frame = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "x double, y double")
    assert frame.agg(safe_corr(F.col("x"), F.col("y"))).first()[0] is None


def test_correlation_uses_complete_pairs(spark):
    x = [1.0, 2.0, 3.0, 4.0, None, 9.0]
    y = [2.0, 1.0, 4.0, float("nan"), 5.0, 3.0]
    frame = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    want = pd.DataFrame({"x": x, "y": y}).corr().iloc[0, 1]
    assert frame.agg(safe_corr(F.col("x"), F.col("y"))).first()[0] == pytest.approx(want)
    assert frame.limit(1).agg(safe_corr(F.col("x"), F.col("y"))).first()[0] is None


ODD_VALUES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, 1 - 2**-53, 1 + 2**-52, 2.0, 3.9999999999999996]
ODD_VALUES += [4.0, 0.1, -7.5, 1e308, -1e308, 1.7976931348623157e308, float("inf"), float("-inf"), 8.0, 7.999999999999999, 1e-300]


def test_order_key_is_the_order_of_doubles(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2047 << 52, 3000, dtype=np.int64)
    values = sorted({*ODD_VALUES, *bits.view(np.float64).tolist(), *(-bits.view(np.float64)).tolist(), *(2.0 ** np.arange(-1074, 1024)).tolist()})
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", stats.order_key(F.col("v")).alias("key"))
    keys = {r.v: r.key for r in frame.collect()}
    for v, key in keys.items():
        want = int(np.float64(abs(v)).view(np.int64))
        assert key == (-want if v < 0 else want), v


@pytest.mark.parametrize("most", [1, 3, 50])
def test_quantiles_by_histograms(spark, monkeypatch, most):
    """Every digit of the values is needed somewhere: neighbours, powers of two, both signs, copies."""
    monkeypatch.setattr(stats, "MOST_IN_BIN", most)
    rng = np.random.default_rng(most)
    near = [float(np.nextafter(100.0, 200.0) + k * 2.0**-46) for k in range(40)]
    values = {
        "near": near * 3,
        "wide": [float(x) for x in rng.normal(0, 1, 200) * 10.0 ** rng.integers(-30, 30, 200)],
        "copies": [7.25] * 300 + [7.5] * 3,
        "few": [1.0, -2.0],
        "prices": [float(x) for x in np.round(rng.gamma(2.0, 50.0, 400), 2)],
    }
    frame = spark.createDataFrame([(k, v) for k, some in values.items() for v in some], "k string, v double")
    got = {r.k: r for r in group_quantiles(frame, ["k"], "v", PROBS).collect()}
    assert set(got) == set(values)
    for k, some in values.items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(float(np.quantile(some, p)), rel=1e-12, abs=0), (k, name)


def test_quantiles_do_not_sort_the_cluster(spark):
    text = group_quantiles(spark.createDataFrame(sample()), ["k"], "v", PROBS)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in text


@pytest.mark.parametrize("most", [2, 1 << 14])
def test_weights_of_rows_that_share_a_value(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "MOST_IN_BIN", most)
    rng = np.random.default_rng(5)
    rows = [(f"g{g}", float(v), int(n)) for g in range(40) for v, n in zip(rng.integers(0, 6, 9), rng.integers(1, 5, 9))]
    got = {r.k: r for r in group_quantiles(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", PROBS, weight="n").collect()}
    for k in {k for k, _, _ in rows}:
        some = [v for g, v, n in rows if g == k for _ in range(n)]
        assert [got[k][name] for name in PROBS] == pytest.approx([float(np.quantile(some, p)) for p in PROBS.values()]), k
