"""Readers and writers of raw and cleaned listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions.stats import attach
from shelfscope.schemas import (
    CLEANED_FIELDS,
    CLEANED_NUMBERS,
    CLEANED_TIMES,
    LANDED_CLEANED,
    LEGACY_CLEANED,
    RAW_FIELDS,
    RAW_LISTING,
)
from shelfscope.session import materialise

MARKET = ["store", "city"]
CLEANED_FILES = "{*_cleaned,part-*}.csv"  # single files of a feed, and what :func:`write_cleaned` writes


def _files(reader: DataFrameReader, pattern: str) -> DataFrameReader:
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The lines of text files with their file, the block of it they were read in, and a number that grows within a block.

    A block is what one task reads: ``spark.sql.files.maxPartitionBytes`` at
    most, or a whole compressed file.  ``_out`` and ``_in`` tell whether a line
    ends inside a quoted cell when it begins outside or inside of one.
    """
    block = F.col("_metadata.file_block_start")
    marked = F.col("value").startswith("\ufeff") & (block == 0)
    lines = _files(spark.read, pattern).option("lineSep", "\n").text(folder).select(
        F.when(marked, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("file_name"),
        block.alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    quoted = F.col("value").contains('"')
    ends = {name: F.when(quoted, _ends_inside(F.col("value"), begins)).otherwise(begins) for name, begins in (("_out", False), ("_in", True))}
    return lines.withColumns(ends)


def _ends_inside(line: Column, begins_inside: bool) -> Column:
    """Whether a line ends inside a quoted cell.

    Doubled quotes never matter.  Of the others, one inside a cell ends it, and
    one outside opens a cell only where a cell begins; elsewhere (5" pipe) it is
    text.
    """
    parts = F.split(F.replace(line, F.lit('""'), F.lit("")), '"', -1)
    opens = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part, i: part.endswith(",") | ((i == 0) & (part == ""))
    )
    return F.aggregate(opens, F.lit(begins_inside), lambda inside, opening: ~inside & opening)


def _followed(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows with what the rows before them in their group do to the state: see :func:`_begins_inside`."""
    window = Window.partitionBy(*group).orderBy(order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_flips", F.sum((F.col("_out") & ~F.col("_in")).cast("long")).over(window))
        .withColumn("_fixed", F.last(F.when(F.col("_out") == F.col("_in"), F.struct("_out", "_flips")), True).over(before))
        .withColumn("_so_far", F.lag("_flips", 1, 0).over(window))
    )


def _begins_inside(start: Column) -> Column:
    """The state at a row whose group begins in ``start``: what the last row with a fixed end left, turned by the flips since."""
    flips = F.col("_so_far") - F.coalesce(F.col("_fixed._flips"), F.lit(0))
    return F.coalesce(F.col("_fixed._out"), start) != (flips % 2 == 1)


def _ends(start: Column) -> Column:
    return F.when(_begins_inside(start), F.col("_in")).otherwise(F.col("_out"))


def _records(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The records of CSV files, each on as many lines as its quoted cells take.

    A file is read by as many tasks as it has blocks.  The quotes of a block
    make a function from the state it begins in to the state it ends in; these
    functions, one row a block, are followed through the file, and then every
    line knows whether it begins inside a cell.  Lines that are a record of
    their own stay where they are; only the others are gathered by record.
    """
    lines = _lines(spark, folder, pattern)
    place = ["_path", "_block"]
    ends = (
        _followed(lines.filter(F.col("value").contains('"')).drop("value"), place, "_at")
        .groupBy(*place)
        .agg(*[F.max_by(_ends(F.lit(start)), "_at").alias(name) for name, start in (("_out", False), ("_in", True))])
    )
    blocks = lines.select(*place).distinct().join(ends, place, "left")
    blocks = blocks.fillna({"_out": False, "_in": True})
    blocks = materialise(_followed(blocks, ["_path"], "_block").select(*place, _begins_inside(F.lit(False)).alias("_start")))

    so_far = Window.partitionBy(*place).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    begins, written = F.col("_begins"), ~F.col("value").isin("", "\r")
    lines = _followed(attach(lines, blocks, place), place, "_at").select(
        "value", *place, "file_name", "_at",
        _begins_inside(F.col("_start")).alias("_begins"),
        _ends(F.col("_start")).alias("_ends"),
        ((F.min(F.when(written, F.col("_at"))).over(so_far) == F.col("_at")) & (F.col("_block") == 0)).alias("_head"),
    )
    lines = materialise(lines.withColumn("_record", F.last(F.when(~begins, F.col("_at")), True).over(so_far)))
    columns = ["_path", "file_name"]
    whole = lines.filter(~begins & ~F.col("_ends")).select(*columns, F.col("_at").alias("row_pos"), "_head", "value")
    parts = lines.filter(begins | F.col("_ends"))
    # Lines before the first record of a block go on with the record an earlier block left open.
    in_file = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = parts.groupBy(*place).agg(F.max("_record").alias("_last"))
    opened = materialise(opened.select(*place, F.last("_last", True).over(in_file).alias("_open")))
    parts = attach(parts, opened, place).withColumn("row_pos", F.coalesce("_record", "_open"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))), lambda line: line["value"])
    glued = parts.groupBy(*columns, "row_pos").agg(F.max("_head").alias("_head"), F.array_join(in_order, "\n").alias("value"))
    records = whole.unionByName(glued)
    ended = F.col("value").endswith("\r")
    text = F.when(ended, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return records.withColumn("value", text).filter("value != ''")


def _csv_options(width: int) -> dict[str, str]:
    return {
        "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxColumns": str(max(20_480, 2 * width)), "header": "false",
    }


def _schema(width: int) -> str:
    return ", ".join(f"_c{i} string" for i in range(width))


def _cells(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The records of CSV files as arrays of cells, the first of each file marked as its head.

    Quotes are doubled inside quoted cells.  As many cells are read as the
    widest head can have; a comma inside quotes counts too, which only reads a
    cell more.
    """
    records = _records(spark, folder, pattern)
    width = records.filter("_head").agg(F.max(F.size(F.split("value", ",", -1)))).first()[0] or 1
    row = F.from_csv("value", _schema(width), _csv_options(width) | {"multiLine": "true"})
    cells = F.array(*[F.col(f"_row._c{i}") for i in range(width)]).alias("_cells")
    return records.withColumn("_row", row).select(cells, "_path", "file_name", "row_pos", "_head")


def _widest_first_line(spark: SparkSession, folder: str, pattern: str) -> int:
    lines = _files(spark.read, pattern).text(folder).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    first = lines.filter("_block = 0 and value != ''").groupBy("_path").agg(F.min_by("value", "_at").alias("value"))
    return first.agg(F.max(F.size(F.split("value", ",", -1)))).first()[0] or 1


def _cells_of_lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """As :func:`_cells`, for feeds known to have a record on every line: nothing is shuffled but the heads."""
    width = _widest_first_line(spark, folder, pattern)
    reader = _files(spark.read.schema(_schema(width)).options(**_csv_options(width)).option("encoding", "UTF-8"), pattern)
    rows = reader.csv(folder).select(
        F.array(*[f"_c{i}" for i in range(width)]).alias("_cells"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("row_pos"),
    )
    first = rows.filter("_block = 0").groupBy("_path").agg(F.min("row_pos").alias("_first"))
    return attach(rows, first, ["_path"]).withColumn("_head", F.coalesce(F.col("row_pos") == F.col("_first"), F.lit(False)))


def _by_name(rows: DataFrame, fields: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Cells under the names in the first line of their own file.

    Files may order their columns as they like, lack some (empty text) and have
    others (left out).
    """
    names = F.transform("_cells", lambda name: F.trim(F.replace(name, F.lit("\ufeff"), F.lit(""))))
    first = rows.filter("_head").select("_path", names.alias("_header"))
    placed = attach(rows.filter("not _head"), first, ["_path"])

    def cell(name: str) -> Column:
        place = F.array_position("_header", F.lit(name)).cast("int")
        return F.coalesce(F.when(place > 0, F.get("_cells", place - 1)), F.lit("")).alias((renamed or {}).get(name, name))

    return placed.select(*map(cell, fields), "file_name", "row_pos")


def _read(spark: SparkSession, folder: str, pattern: str, multi_line: bool) -> DataFrame:
    return (_cells if multi_line else _cells_of_lines)(spark, folder, pattern)


def _sortable(place: Column) -> Column:
    """A whole number as text of equal order."""
    return F.lpad(place.cast("string"), 20, "0")


def read_raw_listings(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """All raw listing files of a folder, by column name; empty and missing cells are empty text, as in the feed."""
    return _by_name(_read(spark, folder, "*.csv", multi_line), RAW_FIELDS)


def read_cleaned_listings(
    spark: SparkSession, folder: str, multi_line: bool = True, pattern: str = CLEANED_FILES
) -> DataFrame:
    """All cleaned listing files of a folder, by column name, numbers and times typed (NULL when unreadable).

    Files that carry ``file_name`` and ``row_pos`` columns, as ours do, keep
    them: rows are then in the order of the feeds they came from.
    """
    kept = {"file_name": "_kept_file", "row_pos": "_kept_place"}
    rows = _by_name(_read(spark, folder, pattern, multi_line), [*CLEANED_FIELDS, *kept], kept)
    rows = rows.select(
        *CLEANED_FIELDS,
        F.coalesce(F.nullif("_kept_file", F.lit("")), "file_name").alias("file_name"),
        F.coalesce(F.nullif("_kept_place", F.lit("")), _sortable(F.col("row_pos"))).alias("row_pos"),
    )
    typed = {c: F.col(c).try_cast("double") for c in CLEANED_NUMBERS}
    typed |= {c: F.col(c).try_cast("timestamp") for c in CLEANED_TIMES}
    return rows.withColumns(typed)


def read_legacy_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Older cleaned listings (JSON lines with ``title``) in the present form."""
    rows = spark.read.schema(LEGACY_CLEANED).option("pathGlobFilter", "*.json*").json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_name")).withColumn(
        "row_pos", _sortable(F.monotonically_increasing_id())
    )
    return rows.withColumnRenamed("title", "name").withColumns(
        {c: F.col(c).try_cast("timestamp") for c in CLEANED_TIMES}
    )


def union_listings(present: DataFrame, legacy: DataFrame) -> DataFrame:
    """Both forms of cleaned listings in one table, missing columns NULL."""
    return present.unionByName(legacy, allowMissingColumns=True)


def arrival_order(listings: DataFrame) -> DataFrame:
    """Add ``ord`` = (file, position), the order in which rows are resolved."""
    return listings.withColumn("ord", F.struct("file_name", "row_pos"))


def append_raw_listings(raw: DataFrame, folder: str) -> None:
    """Append raw listings to their store and city; writes nothing when there are none.

    Rows are gathered by market first, a large market in several parts, so that
    a market gets few files of good size.
    """
    if not raw.isEmpty():
        rows = raw.select(*RAW_FIELDS).hint("rebalance", *MARKET)
        rows.write.mode("append").partitionBy(*MARKET).parquet(folder)


def read_landed_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listings written by :func:`append_raw_listings`; filters on store and city skip folders.

    Each store and city is one feed, ordered by scrape time.
    """
    rows = spark.read.schema(RAW_LISTING).parquet(folder)
    return rows.select(
        *RAW_FIELDS,
        _feed(),
        F.concat_ws(
            "|", F.coalesce("timestamp", F.lit("")), F.col("_metadata.file_path"), _sortable(F.col("_metadata.row_index"))
        ).alias("row_pos"),
    )


def _feed() -> Column:
    return F.concat_ws("_", *MARKET).alias("file_name")


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a landed feed with their market and feed; no column of the data is read."""
    rows = spark.read.schema(RAW_LISTING).parquet(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), *MARKET, _feed()).distinct()


def seen_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files an earlier call has noted; none where there is no note yet."""
    try:
        return spark.read.schema("path string").parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "path string")
        raise


def replace_cleaned(cleaned: DataFrame, folder: str) -> None:
    """Replace the folders of the stores and cities in ``cleaned`` and no others; row positions are text already."""
    rows = cleaned.select(*CLEANED_FIELDS, "file_name", "row_pos").hint("rebalance", *MARKET)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MARKET).parquet(folder)


def write_cleaned(cleaned: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Replace the cleaned listings, one folder per store and city; nothing when empty.

    The feed and the place in it go along (as text in sortable form), so that
    the landed table can be matched later in the order of arrival.
    """
    if cleaned.isEmpty():
        return
    place = F.col("row_pos")
    if not isinstance(cleaned.schema["row_pos"].dataType, T.StringType):
        place = _sortable(place)
    rows = cleaned.select(*CLEANED_FIELDS, "file_name", place.alias("row_pos"))
    if fmt == "csv":
        # Text files carry all columns themselves; the folders are for people.
        rows = rows.withColumns({f"_{c}": F.col(c) for c in MARKET})
        out = rows.hint("rebalance", *MARKET).write.mode("overwrite").partitionBy(*[f"_{c}" for c in MARKET])
        out = out.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "")
    else:
        out = rows.hint("rebalance", *MARKET).write.mode("overwrite").partitionBy(*MARKET)
    out.format(fmt).save(folder)


def read_landed_cleaned(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """Cleaned listings written by :func:`write_cleaned`, in the order of their feeds."""
    if fmt == "csv":
        return read_cleaned_listings(spark, folder)
    return spark.read.schema(LANDED_CLEANED).parquet(folder).select(*CLEANED_FIELDS, "file_name", "row_pos")
