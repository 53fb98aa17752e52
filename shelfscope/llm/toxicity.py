"""Toxicity from class-conditional Kneser-Ney models.

A word's probability in a class comes from its continuation count there: the
number of different words it follows, which copies of a text do not raise.  The
count is discounted by up to ``DISCOUNT``, and what the discount frees goes to
the continuation counts shared by both classes, so an expression that is rare
has the same probability under either model and says nothing.  A text is
compared by its log-likelihood ratio per word, over the whole text and over its
most suspicious window; a logistic curve fitted on labelled rows outside the
counts turns the two into a probability.

Words are counted by their 64-bit hash in a table that grows with the corpus;
counts cover every labelled row outside the held-out fold but the rows,
``CALIBRATION_ROWS`` at most, the curve is fitted on.  A word that no class has
more than ``DISCOUNT`` times has the ratio of an unknown one, so only the others
are needed for scoring: up to ``TABLE_WORDS`` of them are sent to the tasks,
more are joined to the words of the texts by a shuffle, with the same scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfscope.llm.base import SLICE_BYTES, emitted, free, given_back, scan, slices, struct, written
from shelfscope.llm.spans import LETTERS, Words, bytes_of, first_of
from shelfscope.session import intermediates

TABLE_WORDS = 1 << 20  # most words sent to the tasks, 12 bytes each; more are joined
VOCABULARY = 1 << 22  # words the shared backoff reckons with, or all that are counted if they are more
DISCOUNT = 3.0  # counts up to this are left to the shared backoff
UNIFORM = 0.5  # added to every shared count
WINDOW = 5  # words
THRESHOLD = 0.3
CALIBRATION_ROWS = 20_000  # most rows the logistic curve is fitted on
FOLDS, HELD_OUT, CALIBRATION_SHARE = 4, 2, 5  # folds by crc32 of the id; one in five training rows may be for calibration

FEATURES = struct(whole=T.DoubleType(), window=T.DoubleType(), size=T.DoubleType())
NAMES = FEATURES.names


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string"))


def word_numbers(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The words and their 64-bit hashes, as Spark's signed numbers."""
    data, at = bytes_of(texts)
    words = Words(data, at, LETTERS, lower=True)
    return words, words.hashes.view(np.int64)


PACKED = struct(packed=T.BinaryType())
PAIRS = struct(word=T.LongType(), before=T.LongType(), classes=T.ByteType())
LEVEL = 6  # of compression
LEAST_RATIO = 3  # packed texts are unpacked in slices this much smaller than plain ones


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the compressed text of every row: what goes through the shuffle to the labels."""

    def make():
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        return lambda texts: {"packed": [None if x is None else pack(x.encode()) for x in texts.to_pylist()]}

    return scan(docs, [id_col], text_col, PACKED, make)


def pairs_of_packed(labelled: DataFrame) -> DataFrame:
    """The pairs of every slice of labelled rows (toxic, packed)."""

    def work(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES // LEAST_RATIO):
                texts = [None if x is None else unpack(x) for x in part.column(1).to_pylist()]
                both = [part.column(0), pa.array(texts, pa.binary()).cast(pa.string())]
                yield from pairs_of(pa.RecordBatch.from_arrays(both, ["toxic", "text"]))
        given_back()

    return labelled.select("toxic", "packed").mapInArrow(work, PAIRS)


def pairs_of(part: pa.RecordBatch):
    """The distinct (previous word, word) pairs of a slice and the classes they occur in; a text begins with word 0."""
    words, number = word_numbers(part.column(1))
    classes = part.column(0).to_numpy(zero_copy_only=False).astype(np.int8)[words.owner] + np.int8(1)
    before = np.concatenate([[0], number[:-1]])[: len(number)].astype(np.int64)
    begins = first_of(words.owner, words.n_texts)[:-1]
    before[begins[begins < len(number)]] = 0
    order = np.lexsort((before, number))
    before, number, classes = before[order], number[order], classes[order]
    first = np.ones(len(order), bool)
    first[1:] = (number[1:] != number[:-1]) | (before[1:] != before[:-1])
    at = np.flatnonzero(first)
    both = np.bitwise_or.reduceat(classes, at) if len(at) else classes
    yield pa.RecordBatch.from_arrays([pa.array(number[at]), pa.array(before[at]), pa.array(both)], ["word", "before", "classes"])


def continuation_counts(labelled: DataFrame, text_col: str | None = None) -> DataFrame:
    """Per word: how many different words it follows in ordinary, in toxic and in all labelled texts, plain or ``packed``."""
    pairs = emitted(labelled, ["toxic"], text_col, PAIRS, lambda: pairs_of) if text_col else pairs_of_packed(labelled)
    pairs = pairs.groupBy("word", "before").agg(F.bit_or("classes").alias("classes"))
    return pairs.groupBy("word").agg(
        F.sum(F.col("classes").bitwiseAND(F.lit(1).cast("byte"))).alias("ordinary"),
        F.sum(F.shiftright("classes", 1)).alias("toxic"),
        F.count(F.lit(1)).alias("shared"),
    )


@dataclass
class Ratios:
    """log P(word | toxic) - log P(word | ordinary): that of an unknown word, and the words with another."""

    unseen: float
    words: DataFrame | None = None  # word, ratio; where they are joined
    table: Broadcast | None = None  # sorted words and their ratios; where they are few

    def of(self, number: np.ndarray) -> np.ndarray:
        ratio = np.full(len(number), self.unseen, np.float32)
        if self.table is not None and len(self.table.value[0]):
            known, ratios = self.table.value
            at = np.minimum(np.searchsorted(known, number), len(known) - 1)
            found = known[at] == number
            ratio[found] = ratios[at[found]]
        return ratio


def log_ratios(counts: DataFrame, table_words: int) -> Ratios:
    """The ratios of the words a class has more than DISCOUNT times; the others' is that of the shared backoff."""
    freed = {c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).alias(f"freed_{c}") for c in ("ordinary", "toxic")}
    differs = (F.col("ordinary") > DISCOUNT) | (F.col("toxic") > DISCOUNT)
    total = counts.agg(
        F.sum("ordinary").alias("ordinary"),
        F.sum("toxic").alias("toxic"),
        F.sum("shared").alias("shared"),
        F.count(F.lit(1)).alias("words"),
        F.count_if(differs).alias("differing"),
        *freed.values(),
    ).first()
    if not total.ordinary or not total.toxic:
        return Ratios(0.0)
    backoff = (F.col("shared") + UNIFORM) / (total.shared + UNIFORM * max(VOCABULARY, total.words))

    def log_probability(c: str) -> Column:
        kept = F.col(c) - F.least(F.col(c).cast("double"), F.lit(DISCOUNT))
        return F.log((kept + total[f"freed_{c}"] * backoff) / total[c])

    unseen = math.log(total.freed_toxic / total.toxic) - math.log(total.freed_ordinary / total.ordinary)
    words = counts.filter(differs).select("word", (log_probability("toxic") - log_probability("ordinary")).cast("float").alias("ratio"))
    if total.differing > table_words:
        return Ratios(unseen, words=written(words, outlives=True))
    rows = words.toArrow().sort_by("word")
    table = (rows["word"].to_numpy(), rows["ratio"].to_numpy())
    return Ratios(unseen, table=counts.sparkSession.sparkContext.broadcast(table))


def features_of(words: Words, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text, the largest over its windows, and the logarithm of its length."""
    n = words.n_texts
    ratio = ratio.astype(np.float64)
    begins = first_of(words.owner, n)
    sizes = np.diff(begins)
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    whole = (sums[begins[1:]] - sums[begins[:-1]]) / np.maximum(sizes, 1)
    ends = np.minimum(np.arange(len(ratio)) + WINDOW, begins[1:][words.owner])
    windows = (sums[ends] - sums[:-1]) / WINDOW
    most = np.zeros(n)
    filled = sizes > 0
    if filled.any():
        most[filled] = np.maximum.reduceat(windows, begins[:-1][filled])
    return np.stack([whole, most, np.log1p(sizes)], axis=1)


def places_of(part: pa.RecordBatch):
    """The distinct words of every text (by its digest) and the numbers of the places where they stand."""
    words, number = word_numbers(part.column(1))
    order = np.lexsort((number, words.owner))
    number, owner = number[order], words.owner[order]
    place = (order - first_of(words.owner, words.n_texts)[owner]).astype(np.int32)
    first = np.ones(len(order), bool)
    first[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    offsets = np.append(at, len(order)).astype(np.int64) * 4
    places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(place)])
    yield pa.RecordBatch.from_arrays(
        [part.column(0).take(pa.array(owner[at])), pa.array(number[at]), places.cast(pa.binary())], ["digest", "word", "places"]
    )


def with_ratios(docs: DataFrame, text_col: str, ratios: Ratios, found_col: str) -> DataFrame:
    """``docs`` and ``__found``: the known words of the text, as pairs of places and ratio.

    Texts are told apart by their digests, so a text that stands in many rows is
    joined once, and the words go through the shuffle one row a word and text.
    """
    digest = free("__digest", docs.columns)
    keyed = docs.withColumn(digest, F.md5(F.col(f"`{text_col}`").cast("string")))
    schema = struct(digest=T.StringType(), word=T.LongType(), places=T.BinaryType())
    words = emitted(keyed, [digest], text_col, schema, lambda: places_of).distinct()
    found = (
        words.join(ratios.words.hint("merge"), "word")
        .groupBy(F.col("digest").alias(digest))
        .agg(F.collect_list(F.struct("places", "ratio")).alias(found_col))
    )
    return keyed.join(found.hint("merge"), digest, "left").drop(digest)


def measured(docs: DataFrame, keep: list[str], text_col: str, ratios: Ratios, results: T.StructType, of: Callable) -> DataFrame:
    """``keep`` columns of every row next to ``of`` the features of its text."""
    joined = ratios.words is not None
    if joined:
        found_col = free("__found", docs.columns)
        docs = with_ratios(docs, text_col, ratios, found_col)
    schema = T.StructType([*(docs.schema[c] for c in keep), *results.fields])
    arrow = to_arrow_schema(schema)
    known = Ratios(ratios.unseen, table=ratios.table)  # no DataFrame goes to the tasks

    def run(part: pa.RecordBatch):
        words, number = word_numbers(part.column(part.num_columns - 1))
        ratio = known.of(number)
        if joined:
            begins = first_of(words.owner, words.n_texts)
            for begin, found in zip(begins, part.column(len(keep)).to_pylist(), strict=False):
                for pair in found or ():
                    ratio[begin + np.frombuffer(pair["places"], np.int32)] = pair["ratio"]
        found = of(features_of(words, ratio))
        columns = [part.column(i) for i in range(len(keep))] + [pa.array(found[f.name]) for f in results.fields]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return emitted(docs, [*keep, found_col] if joined else keep, text_col, schema, lambda: run)


class Curve:
    """A logistic curve over standardised features, fitted by Newton's method with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = self.design(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(30):
            p = self.probability(z)
            gradient = z.T @ (p - y) + 1e-3 * self.weights
            curvature = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(self.weights))
            self.weights = self.weights - np.linalg.solve(curvature, gradient)

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.probability(self.design(x))


class Constant:
    """The share of toxic labels, where there are not both classes to tell apart."""

    def __init__(self, share: float):
        self.share = share

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, calibration_rows: int, table_words: int):
    """The log ratios and the curve, learnt from the labelled rows outside the held-out fold."""
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) % FOLDS != HELD_OUT))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    )
    for_curve = F.floor(fold(F.col("__id")) / FOLDS) % CALIBRATION_SHARE == 0
    sample = known.filter(for_curve).orderBy(F.xxhash64("__id"), "__id").limit(calibration_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__words")).filter(fold(F.col("__id")) % FOLDS != HELD_OUT)
    # Labels grow with the corpus, so they meet the texts by a shuffle at every size.
    counted = known.join(sample.hint("merge"), "__id", "left_anti")
    labelled = packed(texts, "__id", "__words").join(counted.hint("merge"), "__id")
    with intermediates(docs.sparkSession):
        counts = written(continuation_counts(labelled))
        ratios = log_ratios(counts, table_words)

    fitting = texts.join(F.broadcast(sample), "__id")  # calibration_rows rows at most
    rows = measured(fitting, ["toxic"], "__words", ratios, FEATURES, lambda x: dict(zip(NAMES, x.T, strict=True))).toPandas()
    y = rows["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        return ratios, Curve(rows[NAMES].to_numpy(float), y)
    return ratios, Constant(float(y.mean()) if len(y) else 0.0)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    keep: list[str] | None = None,
    calibration_rows: int = CALIBRATION_ROWS,
    score: str = "toxic_score",
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """``keep`` columns (the id by default) and the ``score`` of every row, scored on its whole text.

    Labels are read from rows outside the held-out fold only; of several labels
    of an id the largest counts, null labels and ids are passed over.  A null or
    empty text is scored as a text of no words.  Without labels of both classes
    every score is the share of toxic ones (0 without labels).  The curve is
    fitted on ``calibration_rows`` rows at most, chosen by a hash of the id.
    ``table_words`` decides how the ratios reach the texts, not what they are.
    """
    ratios, curve = fitted(docs, labels, id_col, text_col, label_col, calibration_rows, table_words)
    result = struct(**{score: T.DoubleType()})
    return measured(docs, keep or [id_col], text_col, ratios, result, lambda x: {score: curve(x)})


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows scored below ``threshold``, all columns as they were."""
    score = free("__toxic", docs.columns)
    return toxicity(docs, labels, keep=docs.columns, score=score, **options).filter(F.col(score) < threshold).drop(score)


def held_out(key: Column) -> Column:
    return F.coalesce(fold(key) % FOLDS == HELD_OUT, F.lit(False))
