"""The append-only raw feed read as a stream.

New listing files are appended to the landed table as they arrive; nothing is
reprocessed.  Cleaning stays a batch job over the landed table, because copies
and outliers are judged over a whole feed.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfscope.schemas import RAW_FIELDS, RAW_LISTING
from shelfscope.sources.listings import MARKET

# The function below travels to the executors with its code, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _by_name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of whole files under the names in each file's own first line."""
    for batch in batches:
        for text in batch["value"]:
            lines = csv.DictReader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
            rows = [[(line.get(name) or "") for name in RAW_FIELDS] for line in lines]
            yield pd.DataFrame(rows, columns=RAW_FIELDS)


def raw_feed(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw listing files of a folder as a stream, by column name; empty and missing cells are empty text.

    A file is one row until its lines are read, so feeds come in files that fit
    in a task; large ones are landed by the batch reader.
    """
    reader = spark.readStream.option("pathGlobFilter", "*.csv")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder, wholetext=True).select(F.col("value")).mapInPandas(_by_name, RAW_LISTING)


def land_raw_feed(feed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append all waiting files to the landed table, one folder per store and city, and stop."""
    return (
        feed.writeStream.format("parquet")
        .partitionBy(*MARKET)
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
