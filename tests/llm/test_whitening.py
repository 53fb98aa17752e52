"""Whitening against double-precision eigenvectors of an exact covariance, and eigenvectors of planted spectra."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from shelfscope.llm import catalog, whitening

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string, whitened string"


def table(spark, pairs):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in pairs], SCHEMA)


def by_component(rows):
    found: dict = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
    return found


def brute(pairs, components=16):
    """Ids, n, deviations, whitened rows up to the sign of a column, shares."""
    good = [(i, v) for i, v in pairs if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, d = len(fit), len(fit[0])
    total = [sum(v[k] for v in fit) for k in range(d)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, total)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, total)] for v in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    rows = np.array([[(n * a - s) / n for a, s in zip(v, total)] for v in x])
    return [i for i, _ in good], n, deviation, rows @ vectors / np.sqrt(values), values / np.trace(covariance)


def test_query_against_brute_force(spark):
    given = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pydict()
    ids, n, deviation, whitened, explained = brute(list(zip(given["vec_id"], given["embedding"])))
    found = catalog.op13_whitening(spark, FOLDER).collect()
    assert len(found) == 16 * len(ids)
    rows = by_component(found)
    got = np.array([[rows[i][c].whitened for c in range(1, 17)] for i in ids])
    assert np.abs(got * np.sign((got * whitened).sum(0)) - whitened).max() < 1e-8
    assert [rows[i][16].deviation for i in ids] == deviation
    assert all(r.n == n and 0 <= r.identity_error < 1e-9 for r in found)
    assert np.allclose([rows[ids[0]][c].explained for c in range(1, 17)], explained, rtol=1e-9)


def test_odd_rows(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1 + k) for k in range(5)] for _ in range(40)]
    pairs = list(enumerate(vectors))
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]), (105, [1e38] * 5)]
    short = [(106, [1.0, 2.0])]
    copies = [(i, vectors[0]) for i in range(200, 260)] + [(None, vectors[1]), (0, vectors[0])]
    found = whitening.whitening(table(spark, pairs + odd + short + copies), components=3).collect()
    ids, n, deviation, whitened, _ = brute(pairs + copies, 3)
    assert n == 40 and len(found) == 3 * len(ids) and {r.vec_id for r in found} == set(ids)
    rows = by_component(found)
    got = np.array([[rows[i][c].whitened for c in (1, 2, 3)] for i in ids])
    assert np.abs(np.abs(got) - np.abs(whitened)).max() < 1e-9
    assert all(rows[i][1].deviation == x for i, x in zip(ids, deviation))


def test_no_variance_and_no_rows(spark):
    rows = whitening.whitening(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows) == [
        (i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)
    ]
    flat = whitening.whitening(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [4.0, 1.0])])).collect()
    assert {r.component for r in flat if r.whitened is None} == {2} and all(r.identity_error < 1e-12 for r in flat)
    for pairs in ([], [(1, None)], [(1, [])]):
        assert whitening.whitening(table(spark, pairs)).collect() == []


def test_large_entries_stay_exact(spark):
    rng = random.Random(9)
    for size in (2.0**20, 2.0**40, 2.0**50):
        pairs = [(i, [float(np.float32(rng.uniform(-size, size))) for _ in range(3)]) for i in range(30)]
        rows = by_component(whitening.whitening(table(spark, pairs)).collect())
        ids, _, deviation, whitened, _ = brute(pairs)
        assert [rows[i][1].deviation for i in ids] == [x if x < 2**63 else None for x in deviation]
        got = np.array([[rows[i][c].whitened for c in (1, 2, 3)] for i in ids])
        assert np.abs(np.abs(got) - np.abs(whitened)).max() < 1e-9


def test_limbs():
    rng = random.Random(2)
    values = [rng.randrange(-(2**120), 2**120) for _ in range(100)] + [0, -1, 2**84]
    for kind, some in ((object, values), (np.int64, [v >> 58 for v in values])):
        low, middle, high = whitening.limbs(np.array(some, kind))
        assert [int(a) + (int(b) << 42) + (int(c) << 84) for a, b, c in zip(low, middle, high)] == some


SPECTRA = {
    "spread": np.linspace(1, 5, 48),
    "equal": np.ones(20),
    "clusters": np.r_[3 + np.arange(8) * 1e-8, 2 + np.arange(8) * 1e-10, np.linspace(0.1, 1, 16)],
    "half empty": np.r_[np.linspace(1, 2, 6), np.zeros(10)],
    "far apart": np.array([1e6, 1.0, 1e-3]),
    "one": np.array([3.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors_of_planted_spectra(name):
    values = np.sort(SPECTRA[name])[::-1]
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ ((np.eye(d) - q.T @ q) / 2)
    a = (q * values.astype(np.longdouble)) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.eigen(a)
    assert np.abs(got - values).max() <= 1e-15 * values[0]
    wide = vectors.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(d)).max() < 1e-14
    assert np.abs(a @ wide - wide * got).max() < 1e-15 * values[0] * d
    gaps = np.array([min(abs(values[i] - v) for j, v in enumerate(values) if j != i) if d > 1 else 1.0 for i in range(d)])
    for i in np.flatnonzero(gaps > 0):
        # Extended precision holds a vector to its rounding over the gap; beyond that to double precision.
        assert abs(abs((wide[:, i] * q[:, i]).sum()) - 1) < 1e-15 + (1e-18 * values[0] * d / gaps[i]) ** 2
        assert np.abs(np.abs(wide[:, i]) - np.abs(q[:, i])).max() < 1e-15 + 1e-17 * values[0] * d / gaps[i]
