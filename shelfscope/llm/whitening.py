"""Whitening of embeddings by refined eigenvectors of their covariance.

Entries become whole numbers, so sums and second moments over the distinct
vectors are exact whatever the order tasks end in: moments are taken of what is
left after the whole part of the mean, in blocks of tasks, and the remainder of
the mean is taken out in whole numbers too.  Only the sums and the matrix, one
number for two dimensions, come to the driver.

Eigenvectors begin in single precision and are corrected by the iteration of
Ogita and Aishima, which only multiplies matrices, in extended precision.
Eigenvalues closer to each other than the error bound of a step, or than
``CLOSE``, are a cluster; their vectors are turned by the eigenvectors of the
covariance inside the space they span, from which the cluster's mean is taken
first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfscope.llm.base import struct, written
from shelfscope.session import intermediates

SCALE, OFFSET = 64, 1_000_000  # an entry c becomes floor(SCALE * c) + OFFSET
LARGEST = 2.0**56  # entries from here on do not fit a long
COMPONENTS = 16
BLOCK = 4096  # vectors multiplied at once
LIMB = 42  # bits of the parts in which exact sums are added up
ROUNDS = 24  # most corrections; they are quadratic, so five or six do unless eigenvalues cluster
CLOSE = 1e-7  # times the norm: eigenvalues no further apart are a cluster however good the vectors are
NOTHING = 1e-15  # times the dimensions and the largest eigenvalue: below it an eigenvalue is zero

SUMS = struct(cell=T.IntegerType(), n=T.LongType(), low=T.LongType(), middle=T.LongType(), high=T.LongType())
PRODUCTS = struct(cell=T.IntegerType(), value=T.DoubleType())


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers that fit."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)


def blocks(batch: pa.RecordBatch, column: int, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch, ``BLOCK`` rows at a time, and where each block begins."""
    rows = batch.column(column).flatten().to_numpy().reshape(-1, d)
    for begin in range(0, len(rows), BLOCK):
        yield begin, rows[begin : begin + BLOCK]


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as low + 2**LIMB * middle + 4**LIMB * high; the last that is not zero has the sign."""
    mask = (1 << LIMB) - 1
    if values.dtype == object:
        parts = [values & mask, (values >> LIMB) & mask, values >> (2 * LIMB)]
        return [p.astype(np.int64) for p in parts]
    return [values & mask, values >> LIMB, np.zeros_like(values)]


def exact_product(rows: np.ndarray) -> np.ndarray:
    """``rows.T @ rows`` of whole numbers without rounding."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * len(rows) < 1 << 53:
        own = rows.astype(np.float64)
        return (own.T @ own).astype(np.int64)
    if most * most * len(rows) < 1 << 63:
        return rows.T @ rows
    own = rows.astype(object)
    return own.T @ own


def summed(fit: DataFrame, d: int, cells: int, of: Callable[[np.ndarray], list[np.ndarray]]) -> tuple[int, list[int]]:
    """The number of vectors and, added over all blocks, the whole numbers whose limbs ``of`` gives for each."""

    def work(batches):
        n, total = 0, np.zeros((3, cells), np.int64)
        for batch in batches:
            for _, rows in blocks(batch, 0, d):
                n += len(rows)
                total += np.stack(of(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(cells, dtype=np.int32)), pa.array(np.full(cells, n)), *map(pa.array, total)], SUMS.names
        )

    columns = [F.sum(name).alias(name) for name in SUMS.names[1:]]
    found = fit.select("x").mapInArrow(work, SUMS).groupBy("cell").agg(*columns).orderBy("cell").collect()
    return (found[0].n if found else 0), [r.low + (r.middle << LIMB) + (r.high << (2 * LIMB)) for r in found]


@dataclass
class Moments:
    """Exact moments of the fit list: its size, the mean as whole part and rest over n, and the covariance."""

    n: int
    whole: list[int]
    rest: list[int]
    covariance: np.ndarray

    @classmethod
    def of(cls, fit: DataFrame, d: int) -> Moments | None:
        def sums(rows: np.ndarray) -> list[np.ndarray]:
            return [(rows & ((1 << LIMB) - 1)).sum(0), (rows >> LIMB).sum(0), np.zeros(d, np.int64)]

        n, total = summed(fit, d, d, sums)
        if not n:
            return None
        whole = [s // n for s in total]
        rest = [s - n * w for s, w in zip(total, whole, strict=True)]
        centre, (i, j) = np.array(whole, np.int64), np.triu_indices(d)

        def products(rows: np.ndarray) -> list[np.ndarray]:
            return limbs(exact_product(rows - centre)[i, j])

        _, upper = summed(fit, d, len(i), products)
        covariance = np.zeros((d, d), np.longdouble)
        for a, b, moment in zip(i.tolist(), j.tolist(), upper, strict=True):
            covariance[a, b] = covariance[b, a] = extended(n * moment - rest[a] * rest[b], n * n)
        return cls(n, whole, rest, covariance)


def extended(above: int, below: int) -> np.longdouble:
    """A fraction in extended precision."""
    first = above / below
    return np.longdouble(first) + np.longdouble(float(Fraction(above, below) - Fraction(first)))


def clusters(values: np.ndarray, bound: np.longdouble) -> list[slice]:
    """Runs of falling values, two or more, whose neighbours are no further apart than the bound."""
    edges = [0, *(np.flatnonzero(values[:-1] - values[1:] > bound) + 1).tolist(), len(values)]
    return [slice(a, b) for a, b in pairwise(edges) if b - a > 1]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, to double precision; the largest entry of each is positive."""
    size = np.abs(matrix).max(initial=0)
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = (matrix / size).astype(np.longdouble)
    identity = np.eye(len(a), dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    smallest = len(a) * np.finfo(np.longdouble).eps
    norm = np.sqrt((a * a).sum())
    for _ in range(ROUNDS):
        off = identity - x.T @ x
        turned = x.T @ (a @ x)
        turned = (turned + turned.T) / 2  # what rounding adds must turn vectors, not bend them
        values = np.diag(turned) / (1 - np.diag(off))
        order = np.argsort(-values, kind="stable")
        if (order[1:] < order[:-1]).any():
            x = x[:, order]
            continue
        left = turned - np.diag(values)
        bound = np.maximum(2 * (np.sqrt((left * left).sum()) + norm * np.sqrt((off * off).sum())), CLOSE * norm)
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= bound
        change = np.where(near, off / 2, (turned + values[None, :] * off) / np.where(near, 1, apart))
        x = x + x @ change
        groups = clusters(values, bound)
        for group in groups:
            inside = x[:, group]
            middle = values[group].mean()
            narrow = inside.T @ (a @ inside - middle * inside)
            spread = np.abs(narrow).max()
            if spread > smallest * norm:
                turn = np.linalg.eigh(((narrow + narrow.T) / (2 * spread)).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
                turn = turn + turn @ (np.eye(len(turn)) - turn.T @ turn) / 2
                x[:, group] = inside @ turn
        step = np.abs(change).max()
        if step <= smallest:
            break
    x = x / np.sqrt((x * x).sum(0))
    signs = np.sign(x[np.abs(x).argmax(0), np.arange(len(a))])
    return (values * size).astype(np.float64), (x * signs).astype(np.float64)


@dataclass
class Whitening:
    """What turns vectors of whole numbers into whitened coordinates, and how good it is."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    projection: np.ndarray  # dimensions by components; nothing for components without variance
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, moments: Moments, components: int) -> Whitening:
        values, vectors = eigen(moments.covariance)
        values, vectors = values[:components], vectors[:, :components]
        there = values > len(moments.whole) * NOTHING * max(values.max(initial=0), 0)
        trace = float(np.trace(moments.covariance))
        projection = np.where(there, vectors / np.sqrt(np.where(there, values, 1)), np.nan)
        explained = np.where(there, values, 0) / (trace or 1)
        return cls(moments.n, np.array(moments.whole, np.int64), np.array(moments.rest, np.int64), projection, explained)

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.centre).astype(np.float64) - self.rest / self.n) @ self.projection

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)**2, exactly; None where it does not fit a long."""
        own = rows - self.centre
        most = int(np.abs(own).max(initial=0)) * self.n + self.n
        if most * most * rows.shape[1] < 1 << 63:
            gaps = own * self.n - self.rest
            return (gaps * gaps).sum(1).tolist()
        gaps = own.astype(object) * self.n - self.rest.astype(object)
        return [s if s < 1 << 63 else None for s in (gaps * gaps).sum(1).tolist()]

    def measured(self, fit: DataFrame) -> float:
        """The largest entry of the covariance of the whitened fit list minus the identity, over components with variance."""
        d = len(self.centre)
        there = np.flatnonzero(~np.isnan(self.projection).any(0))
        k = len(there)
        if not k:
            return 0.0

        def work(batches):
            total = np.zeros((k + 1, k))
            for batch in batches:
                for _, rows in blocks(batch, 0, d):
                    own = self.whitened(rows)[:, there]
                    total[:k] += own.T @ own
                    total[k] += own.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], PRODUCTS.names)

        found = fit.select("x").mapInArrow(work, PRODUCTS).groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()
        total = np.array([r.value for r in found]).reshape(k + 1, k) / self.n
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fitted(vectors: DataFrame, components: int) -> Whitening | None:
    """The whitening of distinct vectors ``x``; nothing where there are none."""
    with intermediates(vectors.sparkSession):
        fit = written(vectors.select("x").distinct())
        first = fit.select(F.size("x").alias("d")).first()
        moments = first and Moments.of(fit, first.d)
        if not moments:
            return None
        found = Whitening.of(moments, components)
        found.identity_error = found.measured(fit)
    return found


def whitening(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Rows whose vector is null, empty, or has a null or non-finite entry or one
    of 2**56 and more are left out; so are those whose length is not the most
    frequent one (the larger of equally frequent ones).  The fit list has every
    distinct vector once, so copies do not weigh; ties and repeated rows are
    returned each.  Null ids are kept.  A component without variance has a null
    ``whitened`` and explains nothing; a ``deviation`` beyond a long is null.
    Without vectors there are no rows.  Of the table only the id and the vector
    are read, so other columns' names do not matter.
    """
    schema = T.StructType(
        [
            embeddings.schema[id_col],
            *struct(
                component=T.IntegerType(),
                n=T.LongType(),
                deviation=T.LongType(),
                whitened=T.DoubleType(),
                explained=T.DoubleType(),
                identity_error=T.DoubleType(),
            ).fields,
        ]
    )
    good = embeddings.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").alias("x")).filter(finite(F.col("x")) & (F.size("x") > 0))
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    vectors = good.filter(F.size("x") == d).select(F.col(good.columns[0]).alias("id"), whole_numbers(F.col("x")).alias("x"))
    fit = fitted(vectors, components) if common else None
    if not fit:
        return embeddings.sparkSession.createDataFrame([], schema)
    k = fit.projection.shape[1]
    arrow = to_arrow_schema(schema)

    def work(batches):
        for batch in batches:
            for begin, rows in blocks(batch, 1, d):
                m = len(rows)
                ids = batch.column(0).slice(begin, m).take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(fit.deviation(rows), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fit.n)),
                    deviation,
                    pa.array(fit.whitened(rows).ravel(), from_pandas=True),
                    pa.array(np.tile(fit.explained, m)),
                    pa.array(np.full(m * k, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return vectors.mapInArrow(work, schema)
