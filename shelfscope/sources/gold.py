"""Readers and writers of gold products and of the metric tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.schemas import GOLD, GOLD_FLAT, STORE_METRICS


def _array_files(spark: SparkSession, path: str) -> list[str]:
    """The names of the files whose first character that is not blank is ``[``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"))
    first = lines.filter(F.ltrim("value") != "").groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), "place").alias("c"))
    return [r.file for r in first.filter("c = '['").collect()]


def read_gold(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Gold products from parquet, or from JSON: each file is lines or one array, told by its first character.

    A folder may hold both.  A file that is an array is read by one task.
    """
    if fmt == "parquet":
        return spark.read.schema(GOLD).parquet(path)
    arrays = _array_files(spark, path)
    lines = spark.read.schema(GOLD).json(path)
    if not arrays:
        return lines
    whole = spark.read.schema(GOLD).option("multiLine", True).json(path)
    in_array = F.col("_metadata.file_name").isin(arrays)
    return lines.filter(~in_array).unionByName(whole.filter(in_array))


def write_gold(gold: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Gold products as parquet (the main form), JSON lines or a JSON array.

    ``json_array`` writes one line per row with the commas and brackets placed
    so that each part file is one array; other tools read it as such.
    """
    if fmt == "parquet":
        gold.write.mode("overwrite").parquet(folder)
    elif fmt == "json":
        gold.write.mode("overwrite").json(folder)
    elif fmt == "json_array":
        _as_json_array(gold).write.mode("overwrite").text(folder)
    else:
        raise ValueError(f"unknown gold format {fmt!r}")


def _as_json_array(rows: DataFrame) -> DataFrame:
    """Lines which make every part file one JSON array, written by its task in passing."""

    def frame(batches):
        import pandas as pd

        first = True
        for batch in batches:
            if len(batch) == 0:
                continue
            lines = batch["value"]
            lead = pd.Series([","] * len(lines), index=lines.index)
            if first:
                lead.iloc[0] = "["
                first = False
            yield pd.DataFrame({"value": lead + lines})
        if not first:
            yield pd.DataFrame({"value": ["]"]})

    return rows.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(frame, "value string")


def flatten_gold(gold: DataFrame) -> DataFrame:
    """The scalar columns of gold, offers dropped."""
    return gold.select(*GOLD_FLAT)


def write_flat_gold(gold: DataFrame, folder: str) -> None:
    """Flat gold as CSV with a header; nothing when empty."""
    flat = flatten_gold(gold)
    if not flat.isEmpty():
        flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def read_metrics(spark: SparkSession, path: str, schema=STORE_METRICS) -> DataFrame | None:
    """A metric table written as CSV, or None when there is none."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_metric_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Each table to its own folder under ``folder``, named after it."""
    for name, table in tables.items():
        out = table.write.mode("overwrite")
        if fmt == "csv":
            out = out.option("header", True)
        out.format(fmt).save(f"{folder}/{name}")
