"""Near-duplicates: MinHash bands propose pairs, a sequential Bayesian test drops unlikely ones, full sets decide.

Texts with the same set of shingles form a class and are linked at once.
Classes that share a band meet in a bucket.  In a bucket every class is first
held against one pivot; what becomes one component needs no further comparison,
so a bucket full of copies costs one pair a member.  What then lies outside the
largest component of its bucket is compared with all of the bucket, in blocks of
bounded size that put out only pairs close to the threshold: no link between
different sets that the bands proposed is lost, and no bucket is multiplied out.

The bands miss a pair at the threshold with probability (1 - 0.8**6)**48 < 1e-6.
The test looks at the signatures a batch at a time and drops a pair when the
posterior probability that it reaches the threshold is below ``MISS``.  Then the
sets' counts by ``BINS`` parts of the hash range bound the intersection from
above, and full sets decide what is left.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.base import free, scan, slices, struct, written
from shelfscope.llm.components import components
from shelfscope.llm.spans import NOT_SPACE, Words, bytes_of, first_of, mixed, rolling
from shelfscope.session import intermediates

BANDS, ROWS = 48, 6
HASHES = BANDS * ROWS
BATCH = 48  # signature places looked at between two decisions
BINS = 512  # parts of the hash range whose counts bound an intersection
BLOCK = 256  # members of a bucket on either side of one comparison
MISS = 1e-6  # posterior probability of reaching the threshold below which a pair is dropped
THRESHOLD = (80, 100)  # intersection to union, as whole numbers
FRUITFUL = 0.1  # share of a pivot round's pairs that must be links for another round

_random = np.random.default_rng(7)
FACTORS = _random.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)

SIGNED = struct(n=T.LongType(), d1=T.LongType(), d2=T.LongType(), signature=T.BinaryType(), bands=T.ArrayType(T.LongType()))
SETS = struct(shingles=T.BinaryType(), bins=T.BinaryType())
PAIRS = struct(a=T.LongType(), b=T.LongType())


def later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier in the list."""
    order = np.argsort(keys, kind="stable")
    found = np.zeros(len(keys), bool)
    found[order[1:]] = keys[order][1:] == keys[order][:-1]
    return found


def shingle_sets(texts: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as hashes, end to end, and where each text's begin (one more for the end).

    A text with fewer words than a shingle has its whole word sequence as the only one; one without words has none.
    """
    data, at = bytes_of(texts)
    words = Words(data, at, NOT_SPACE, lower=True)
    begins = first_of(words.owner, words.n_texts)
    sizes = np.diff(begins)
    starts = np.arange(len(words))
    starts = starts[starts + ngram <= begins[1:][words.owner]]
    short = np.flatnonzero((sizes > 0) & (sizes < ngram))
    starts = np.concatenate([starts, begins[short]])
    ends = np.concatenate([starts[: len(starts) - len(short)] + ngram, begins[short] + sizes[short]])
    owner = words.owner[starts]
    order = np.argsort(owner, kind="stable")
    starts, ends, owner = starts[order], ends[order], owner[order]
    hashes = rolling(words.hashes, starts, ends)
    new = ~later(mixed(hashes + mixed(owner.astype(np.uint64) + np.uint64(1))))
    return hashes[new], first_of(owner[new], words.n_texts)


def digests(hashes: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
    """Size and a 128-bit order-free digest of each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(salt)))]) for salt in (1, 2)]
    d1, d2 = ((s[begins[1:]] - s[begins[:-1]]).view(np.int64) for s in sums)
    return {"n": np.diff(begins), "d1": d1, "d2": d2}


def shingled(texts: pa.Array, ngram: int) -> dict:
    return digests(*shingle_sets(texts, ngram))


def signed(texts: pa.Array, ngram: int) -> dict:
    """Digest, signature (low byte of each minimum) and band keys of each set; an empty set has neither."""
    hashes, begins = shingle_sets(texts, ngram)
    found = digests(hashes, begins)
    filled = np.flatnonzero(found["n"])
    x = (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((HASHES, len(filled)), np.uint32)
    h = np.empty_like(x)
    for i in range(HASHES if len(filled) else 0):
        np.multiply(x, FACTORS[i], out=h)
        np.add(h, SHIFTS[i], out=h)
        minima[i] = np.minimum.reduceat(h, begins[:-1][filled])
    bands = np.zeros((len(filled), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(filled), b + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + minima[b * ROWS + r])
        bands[:, b] = key
    low = np.ascontiguousarray(minima.T.astype(np.uint8))
    signatures: list = [b""] * len(texts)
    counts = found["n"]
    for row, i in enumerate(filled):
        signatures[i] = low[row].tobytes()
    ends = np.concatenate([[0], np.cumsum(counts > 0)])
    found["signature"] = signatures
    found["bands"] = pa.ListArray.from_arrays(pa.array((ends * BANDS).astype(np.int32)), pa.array(bands.ravel().view(np.int64)))
    return found


def sets(texts: pa.Array, ngram: int) -> dict:
    """The sorted hashes of each set, eight bytes each, and their counts by parts of the hash range (255 means that or more)."""
    hashes, begins = shingle_sets(texts, ngram)
    each = [hashes[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
    parts = [np.bincount((h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS) for h in each]
    return {"shingles": [np.sort(h).tobytes() for h in each], "bins": [np.minimum(p, 255).astype(np.uint8).tobytes() for p in parts]}


def least_matches(n: int, similarity: float, miss: float) -> int:
    """The fewest of ``n`` equal signature places with which a pair may still reach the similarity.

    Two low bytes agree with probability p = J + (1 - J) / 256.  With a uniform prior the posterior of p
    is Beta(m + 1, n - m + 1), and P(p >= q) = P(Binomial(n + 1, q) <= m).
    """
    q = similarity + (1 - similarity) / 256
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * q**m * (1 - q) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def bounds(threshold: tuple[int, int], miss: float) -> list[int]:
    """The fewest matches after each batch with which a pair goes on; made on the driver, so tasks need no table of their own."""
    part, whole = threshold
    return [least_matches(end, part / whole, miss) for end in range(BATCH, HASHES + 1, BATCH)]


def plausible(signatures_a: np.ndarray, signatures_b: np.ndarray, least: list[int]) -> np.ndarray:
    """Whether each pair of signatures survives all batches; pairs that have failed are not looked at again."""
    alive = np.arange(len(signatures_a))
    matches = np.zeros(len(signatures_a), np.int64)
    for batch, fewest in enumerate(least):
        part = slice(batch * BATCH, (batch + 1) * BATCH)
        matches[alive] += (signatures_a[alive, part] == signatures_b[alive, part]).sum(1)
        alive = alive[matches[alive] >= fewest]
    found = np.zeros(len(signatures_a), bool)
    found[alive] = True
    return found


class Facts:
    """Sizes, signatures and counts of some sets, compared pair by pair with those of others."""

    def __init__(self, n: np.ndarray, signatures: list[bytes], bins: list[bytes]):
        self.n = n
        self.signatures = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, HASHES)
        self.bins = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS)

    def close(self, i: np.ndarray, other: Facts, j: np.ndarray, threshold: tuple[int, int], least: list[int]) -> np.ndarray:
        """Which of the pairs (i of these, j of those) may reach the threshold."""
        part, whole = threshold
        n, m = self.n[i], other.n[j]
        left = np.flatnonzero(np.minimum(n, m) * whole >= np.maximum(n, m) * part)
        left = left[plausible(self.signatures[i[left]], other.signatures[j[left]], least)]
        a, b = self.bins[i[left]], other.bins[j[left]]
        most = np.minimum(a, b).sum(1, dtype=np.int64)  # the intersection is no larger, where no count was cut at 255
        cut = (a.max(1, initial=0) == 255) | (b.max(1, initial=0) == 255)
        return left[cut | (most * whole >= (n[left] + m[left] - most) * part)]


def facts_of(batch: pa.RecordBatch, columns: list[str]) -> Facts:
    n, signatures, bins = (batch.column(c) for c in columns)
    return Facts(n.to_numpy(), signatures.to_pylist(), bins.to_pylist())


def surviving(pairs: DataFrame, facts: DataFrame, threshold: tuple[int, int], miss: float) -> DataFrame:
    """The pairs (a, b) whose sizes, signatures and counts leave the threshold possible."""

    def side(name: str) -> DataFrame:
        return facts.select(*[F.col(c).alias(f"{c}_{name}" if c != "node" else name) for c in ("node", "n", "signature", "bins")])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    columns = {name: [f"{c}_{name}" for c in ("n", "signature", "bins")] for name in ("a", "b")}
    least = bounds(threshold, miss)

    def work(batches):
        for batch in batches:
            every = np.arange(batch.num_rows)
            keep = facts_of(batch, columns["a"]).close(every, facts_of(batch, columns["b"]), every, threshold, least)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    return both.select("a", "b", *columns["a"], *columns["b"]).mapInArrow(work, PAIRS)


def close_in_buckets(open_members: DataFrame, facts: DataFrame, threshold: tuple[int, int], miss: float) -> DataFrame:
    """The close pairs of each bucket between what lies outside its largest component and all other components.

    Both sides are dealt into blocks by a hash of the node, and every two blocks
    meet in a task: at most some 2 * BLOCK rows are together, and only close
    pairs come out.
    """
    blocks = {"left": F.ceil(F.col("outside") / BLOCK), "right": F.ceil(F.col("size") / BLOCK)}
    here = open_members.join(facts, "node")

    def dealt(rows: DataFrame, side: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("node", F.lit(side)), blocks[side]).cast("int").alias(side)
        met = F.explode(F.sequence(F.lit(0), (blocks[other] - 1).cast("int"))).alias(other)
        return rows.select("key", "node", "component", "major", "n", "signature", "bins", F.lit(side == "left").alias("first"), own, met)

    right = dealt(here, "right", "left")
    left = dealt(here.filter("component != major"), "left", "right")
    meeting = right.unionByName(left).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    names = ["key", "left", "right", "node", "component", "major", "first", "n", "signature", "bins"]
    least = bounds(threshold, miss)

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, component, major, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "major", "first"))
        own = facts_of(batch, ["n", "signature", "bins"])
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        # Two members outside the largest component meet twice; the one in order counts.
        apart = (component[i] != component[j]) & ((component[j] == major[j]) | (node[i] < node[j]))
        i, j = i[apart], j[apart]
        keep = own.close(i, own, j, threshold, least)
        a, b = np.maximum(node[i[keep]], node[j[keep]]), np.minimum(node[i[keep]], node[j[keep]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def work(batches):
        rest = None  # the rows of a meeting that goes on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            whole = table.to_batches()[0] if table.num_rows else batch
            keys = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("key", "left", "right")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            begins = np.concatenate([[0], edges])
            for a, b in itertools.pairwise(begins):
                yield compared(whole.slice(a, b - a))
            rest = whole.slice(begins[-1])
        if rest is not None and rest.num_rows:
            yield compared(rest)

    return meeting.select(*names).mapInArrow(work, PAIRS).distinct()


def confirmed(pairs: DataFrame, full: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets reach the threshold: whole * |intersection| >= part * |union|."""
    part, whole = threshold
    both = (
        pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(full.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
    )

    def linked(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return whole * common >= part * (len(a) + len(b) - common)

    def work(batches):
        for batch in batches:
            for rows in slices(batch, 2):
                keep = [linked(x, y) for x, y in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
                yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(work, PAIRS)


def components_of_sets(
    rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, ngram: int, threshold: tuple[int, int], miss: float
) -> DataFrame:
    """The component (its smallest id) of every set of shingles, told by its digest; ``rows`` has a signature per row."""
    own = rows.filter("id is not null and n > 0")
    classes = written(own.groupBy("d1", "d2", "n").agg(F.min("id").alias("node")))
    # One row a class: that of its smallest id (repeated rows of it are equal).
    nodes = own.join(classes.select("d1", "d2", F.col("node").alias("id")), ["d1", "d2", "id"]).select(
        F.col("id").alias("node"), "n", "signature", "bands"
    )
    nodes = written(nodes)
    filed = nodes.select("node", F.explode("bands").alias("key"))
    # Written, like all that meets a table that may have a hot key: then both sides of the join are plain shuffles.
    shared = written(filed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).filter("size > 1").select("key", "pivot"))
    members = written(filed.join(shared, "key").distinct())

    # Full sets of the classes that meet another one; only their texts are moved.
    meeting = members.select("node").distinct()
    full = written(
        scan(
            docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("__words")).join(meeting, "node", "left_semi"),
            ["node"],
            "__words",
            SETS,
            lambda: lambda t: sets(t, ngram),
        ).distinct()
    )
    facts = written(full.select("node", "bins").join(nodes.select("node", "n", "signature"), "node").distinct())

    tried = written(members.filter("node > pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    links = written(confirmed(surviving(tried, facts, threshold, miss), full, threshold).distinct())
    found = components(links)
    turn, fruitful = 0, True
    while True:
        # Buckets that still hold different components, with their largest one and a member of it.
        placed = members.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        chance = F.xxhash64("node", F.lit(turn))
        parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("part"), F.min_by("node", chance).alias("pivot"))
        order = F.struct("part", "component")
        several = parts.groupBy("key").agg(
            F.max_by("component", order).alias("major"),
            F.max_by("pivot", order).alias("pivot"),
            F.sum("part").alias("size"),
            (F.sum("part") - F.max("part")).alias("outside"),
        )
        open_members = written(placed.join(written(several.filter("outside > 0")), "key"))
        n_members, n_possible = open_members.agg(
            F.count(F.lit(1)), F.sum(F.when(F.col("component") != F.col("major"), F.col("size")).otherwise(0))
        ).first()
        if not n_members:
            break
        # Up to this, dealing into blocks sends a member to a few meetings; beyond, another pivot comes first.
        last = n_possible <= BLOCK * n_members or not fruitful
        if last:
            pairs = close_in_buckets(open_members, facts, threshold, miss)
        else:
            pairs = open_members.filter("component != major").select(
                F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")
            )
        pairs = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        more = written(confirmed(pairs if last else surviving(pairs, facts, threshold, miss), full, threshold).distinct())
        links = written(links.union(more))
        found = components(links)
        if last:
            break
        fruitful = more.count() > FRUITFUL * pairs.count()
        tried = written(tried.union(pairs))
        turn += 1

    return classes.join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = 5,
    threshold: tuple[int, int] = THRESHOLD,
    miss: float = MISS,
) -> DataFrame:
    """``id``, ``n_shingles``, the digest ``d1``, ``d2`` of the set, ``component_id`` and ``kept`` of every row.

    ``component_id`` is the smallest id reachable over links; ``kept`` is true
    where that is the row's own id, so repeated rows of an id are all kept.  A
    text without words (null, empty, white space) is linked with nothing.  A row
    with a null id takes part in no link: its component is null and it is kept.
    Where an id stands on different texts, each row has the component of its own
    text.  Ids are whole numbers.
    """
    rows = written(
        scan(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__words")), ["id"], "__words", SIGNED, lambda: lambda t: signed(t, ngram))
    )
    with intermediates(docs.sparkSession):
        named = written(components_of_sets(rows, docs, id_col, text_col, ngram, threshold, miss), outlives=True)
    own_rows = rows.select("id", "n", "d1", "d2")
    placed = own_rows.join(named, ["d1", "d2"], "left").withColumn(
        "component_id", F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    )
    return placed.select(
        "id", F.col("n").alias("n_shingles"), "d1", "d2", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, **options) -> DataFrame:
    """One document of each group (that of the smallest id), all columns as they were; what is linked with nothing stays."""
    found = near_duplicates(docs, id_col, text_col, ngram, **options)
    dropped = found.filter(~F.col("kept")).select("id", "d1", "d2").distinct()
    names = {name: free(f"__{name}", docs.columns) for name in ("n", "d1", "d2")}
    marks = struct(**dict.fromkeys(names.values(), T.LongType()))

    def run(texts: pa.Array) -> dict:
        return {names[name]: values for name, values in shingled(texts, ngram).items()}

    marked = scan(docs, docs.columns, text_col, marks, lambda: run)
    same = (marked[id_col].cast("long") == dropped["id"]) & (marked[names["d1"]] == dropped["d1"]) & (marked[names["d2"]] == dropped["d2"])
    return marked.join(dropped, same, "left_anti").drop(*names.values())
