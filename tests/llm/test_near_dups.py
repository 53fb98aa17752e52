"""Near-duplicates and components against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from llm.conftest import ODD

from shelfscope.llm import catalog, near_dups
from shelfscope.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def brute(pairs, n):
    """Component by id of rows with distinct ids: all pairs that can reach the threshold by size."""
    of_set = {}
    for i, t in sorted(pairs):
        of_set.setdefault(shingles(t, n), []).append(i)
    links = [(ids[0], i) for s, ids in of_set.items() if s for i in ids[1:]]
    numbers = {}
    distinct = sorted((s for s in of_set if s), key=len)
    arrays = [np.array(sorted(numbers.setdefault(g, len(numbers)) for g in s)) for s in distinct]
    for i, a in enumerate(arrays):
        for j in range(i + 1, len(arrays)):
            b = arrays[j]
            if 100 * len(a) < 80 * len(b):
                break
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                links.append((of_set[distinct[i]][0], of_set[distinct[j]][0]))
    return roots([i for i, _ in pairs], links)


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.01"
    table = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    pairs = list(zip(table["doc_id"], table["text"], strict=True))
    want = brute(pairs, 2)
    got = catalog.op9_near_dups(spark, folder).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {i: len(shingles(t, 2)) for i, t in pairs}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(want)


def test_chains_and_crowds(docs_of):
    """Neighbours of a chain are linked and its ends are not; a crowd of near copies at the border of the threshold."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choices(words, k=120)
    pairs, text = [], list(base)
    for i in range(40):
        text = list(text)
        text[(i * 3) % 120] = f"new{i}"
        pairs.append((1000 - i, " ".join(text)))
    crowd = rng.choices(words, k=100)
    for i in range(120):
        copy = list(crowd)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(100)] = rng.choice(words)
        pairs.append((2000 + i, " ".join(copy)))
    pairs += [(3000 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    pairs += [(4000, "one"), (4001, "ONE"), (4002, "One  \n"), (4003, "two"), (4004, ""), (4005, None), (4006, " \t")]
    for n in (2, 5):
        got = {r.id: r.component_id for r in near_dups.near_duplicates(docs_of(pairs), ngram=n).collect()}
        assert got == brute(pairs, n)


def test_odd_rows(docs_of):
    got = near_dups.near_duplicates(docs_of([*ODD, (10, "Repeated  row"), (11, "")]), ngram=5).collect()
    seen = Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert seen[(4, 1, 4, True)] == 2 and seen[(10, 1, 4, False)] == 1
    assert seen[(None, 1, None, True)] == 1
    assert seen[(1, 0, 1, True)] == seen[(2, 0, 2, True)] == seen[(3, 0, 3, True)] == seen[(11, 0, 11, True)] == 1
    assert len(got) == len(ODD) + 2
    assert near_dups.near_duplicates(docs_of([])).collect() == []


def test_miss_probability():
    """A pair at the threshold survives the sequential test all but surely; a far pair is dropped early."""
    rng = np.random.default_rng(5)
    n = 4000
    a = rng.integers(0, 256, (n, near_dups.HASHES)).astype(np.uint8)
    agree = rng.random((n, near_dups.HASHES)) < 0.8
    b = np.where(agree, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    assert near_dups.plausible(a, b, near_dups.bounds((80, 100), near_dups.MISS)).all()
    far = np.where(rng.random(a.shape) < 0.3, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    assert near_dups.plausible(a, far, near_dups.bounds((80, 100), near_dups.MISS)).mean() < 0.01


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(250)]
    links += [(7, 7), (None, 3)]
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = roots({x for e in real for x in e}, real)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
