"""Line deduplication over content-defined chunks of lines, in DataFrame operations only.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines is taken at every
line, and a chunk ends where it has a local minimum: the same lines are cut in
the same places whatever stands around them, two lines at least make a chunk and
three on average.  A line of ``LONG`` words or more is a chunk by itself.
Chunks of two or more lines with text (and long lines) are counted by hash over
the whole corpus; occurrences of a repeated hash are then held byte for byte
against its first occurrence, and all but the first are removed.

The lines at the edges of a shared passage fall into chunks with their
neighbours, so of a passage of few lines much or all stays.  With ``passages``
the shortest runs of ``LONG`` words from and up to every line are chunks as
well, which together cover any repeated passage of as many words to its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.base import free, written
from shelfscope.session import intermediates

WINDOW = 2  # lines in the rolling hash
MODULUS = 1_000_003
LONG = 50  # words that make a line a chunk of its own
BASE = 31


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def is_long(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= LONG - 1


def rolling_hashes(hashes: Column) -> Column:
    """At each line, the hash of the last WINDOW line hashes."""

    def at(h: Column, k: Column) -> Column:
        for back in range(1, WINDOW):
            h = h + BASE**back * F.coalesce(F.get(hashes, k - back), F.lit(0))
        return h % MODULUS

    return F.transform(hashes, at)


def chunk_ends(lines: Column, rolled: Column) -> Column:
    """The numbers (from 1) of the lines that end a chunk."""
    n = F.size(lines)

    def ends(i: Column) -> Column:
        here, before, after = F.element_at(rolled, i), F.get(rolled, i - 2), F.get(rolled, i)
        beside_long = is_long(F.element_at(lines, i)) | F.coalesce(is_long(F.get(lines, i)), F.lit(False))
        return (i == n) | beside_long | F.coalesce((here < before) & (here <= after), F.lit(False))

    return F.filter(F.sequence(F.lit(1), n), ends)


def chunks(lines: Column, ends: Column) -> Column:
    """First line, number of lines and hash of every chunk that may be removed."""

    def chunk(end: Column, k: Column) -> Column:
        first = F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1
        size = end - first + 1
        return F.struct(first.alias("first"), size.alias("size"), F.xxhash64(F.slice(lines, first, size)).alias("hash"))

    def may_go(c: Column) -> Column:
        texts = F.filter(F.slice(lines, c.first, c.size), lambda line: F.trim(line) != "")
        return (F.size(texts) >= 2) | ((c.size == 1) & is_long(F.element_at(lines, c.first)))

    return F.filter(F.transform(ends, chunk), may_go)


def word_runs(lines: Column) -> Column:
    """For every line with words the shortest run of LONG words that begins with it, and the shortest that ends with it."""

    def words(line: Column) -> Column:
        return F.size(F.filter(F.split(line, r"\s+"), lambda word: word != ""))

    counted = F.filter(F.transform(lines, lambda line, k: F.struct((k + 1).alias("line"), words(line).alias("words"))), lambda x: x.words > 0)

    def runs(order: Column, forward: bool) -> Column:
        def run(x: Column, k: Column) -> Column:
            following = F.slice(order, k + 1, LONG)  # a line has a word at least
            sums = F.aggregate(
                following,
                F.struct(F.lit(0).alias("words"), F.lit(0).alias("line")),
                lambda have, y: F.when(have.words >= LONG, have).otherwise(F.struct((have.words + y.words).alias("words"), y.line.alias("line"))),
            )
            first, last = (x.line, sums.line) if forward else (sums.line, x.line)
            size = last - first + 1
            key = F.when(sums.words >= LONG, F.xxhash64(F.slice(lines, first, size)))
            return F.struct(first.alias("first"), size.alias("size"), key.alias("hash"))

        return F.filter(F.transform(order, run), lambda c: c.hash.isNotNull())

    return F.array_union(runs(counted, True), runs(F.reverse(counted), False))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def without(lines: Column, removed: Column) -> Column:
    """The text of the lines that stand in no removed chunk; ``removed`` is in order."""
    n = F.size(removed)

    def between(k: Column) -> Column:
        before, after = F.get(removed, k - 1), F.get(removed, k)
        start = F.coalesce(before.first + before.size, F.lit(1))
        return F.slice(lines, start, F.coalesce(after.first, F.size(lines) + 1) - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")


def same(a: DataFrame, b: DataFrame) -> Column:
    return (a["__hash"] == b["__hash"]) & a["__id"].eqNullSafe(b["__id"])


def repeated_chunks(keyed: DataFrame, text: Column, passages: bool = False) -> DataFrame:
    """Per document (``__id``, ``__hash``) its chunks (first, size) that equal an earlier one byte for byte.

    With ``passages`` these may overlap, and their lines are given one by one.
    """
    found = chunks(F.col("lines"), F.col("ends"))
    if passages:
        found = F.concat(found, word_runs(F.col("lines")))
    cut = (
        keyed.select("__id", "__hash", lines_of(text).alias("lines"))
        .filter(F.size("lines") > 0)
        .withColumn("hashes", F.transform("lines", line_hash))
        .withColumn("rolled", rolling_hashes(F.col("hashes")))
        .withColumn("ends", chunk_ends(F.col("lines"), F.col("rolled")))
        .select("__id", "__hash", F.explode(found).alias("chunk"))
        .select("__id", "__hash", F.col("chunk.first").alias("first"), F.col("chunk.size").alias("size"), F.col("chunk.hash").alias("key"))
    )
    cut = written(cut)
    often = cut.groupBy("key").count().filter("count > 1").select("key")
    candidates = (
        cut.join(often, "key")
        .distinct()  # repeated rows are one document
        .groupBy("__id", "__hash")
        .agg(F.sort_array(F.collect_list(F.struct("first", "size", "key"))).alias("chunks"))  # of one text
    )

    whole = keyed.select("__id", "__hash", text.alias("__text"))
    occurrences = written(
        candidates.join(whole.hint("merge"), same(candidates, whole))  # both sides grow with the corpus
        .select(candidates["__id"], candidates["__hash"], lines_of(F.col("__text")).alias("lines"), F.explode("chunks").alias("chunk"))
        .select(
            "__id",
            "__hash",
            "chunk.*",
            F.array_join(F.slice("lines", F.col("chunk.first"), F.col("chunk.size")), "\n").alias("words"),
        )
    )
    place = Window.partitionBy("key", "words").orderBy("__id", "__hash", "first")
    earliest = (
        occurrences.withColumn("rank", F.row_number().over(place))
        .filter("rank = 1")  # a limit that is taken before the shuffle
        .select("key", F.col("words").alias("first_words"), F.col("__id").alias("first_id"), F.col("__hash").alias("first_hash"), F.col("first").alias("first_first"))
    )
    is_first = F.col("__id").eqNullSafe(F.col("first_id")) & (F.col("__hash") == F.col("first_hash")) & (F.col("first") == F.col("first_first"))
    repeats = occurrences.join(earliest, "key").filter((F.col("words") == F.col("first_words")) & ~is_first)
    if passages:
        repeats = repeats.select("__id", "__hash", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("first"), F.lit(1).alias("size"))
    return (
        repeats.select("__id", "__hash", "first", "size")
        .distinct()
        .groupBy("__id", "__hash")
        .agg(F.sort_array(F.collect_list(F.struct("first", "size"))).alias("__chunks"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """Every row with its text less the repeated chunks, all other columns as they were, and ``__removed`` lines (``__removed_`` where a column has that name).

    The occurrence that stays is that of the smallest id (null ids first), then
    of the smallest text hash, then the earliest in the text; repeats inside one
    text go as well.  Repeated rows (same id and text) are one document: each
    keeps what the document keeps.  Null and empty texts stay as they are; a
    text all of whose chunks stand elsewhere becomes empty.  ``passages`` also
    removes every line of repeated passages of LONG words or more.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column can clash with a helper
    key, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    keyed = docs.toDF(*names).withColumns({"__id": key, "__hash": F.xxhash64(key, text)})
    with intermediates(docs.sparkSession):
        removed = written(repeated_chunks(keyed, text, passages), outlives=True)
    joined = keyed.join(removed.hint("merge"), same(keyed, removed), "left")
    gone = F.aggregate("__chunks", F.lit(0), lambda total, c: total + c["size"])
    cleaned = F.when(F.col("__chunks").isNull(), text).otherwise(without(lines_of(text), F.col("__chunks")))
    return joined.select(
        *[(cleaned if c == text_col else keyed[name]).alias(c) for name, c in zip(names, docs.columns, strict=True)],
        F.coalesce(gone, F.lit(0)).cast("long").alias(free("__removed", docs.columns)),
    )
