"""What the operators of this subpackage share: scans in slices of bounded size, and cut lineage."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfscope.session import materialise

SLICE_BYTES = 2 << 20  # text worked on at once by a task; a longer single text makes a slice of its own

written = materialise

def kept(name: str, build: Callable):
    """What ``build`` gives, built once in the life of a worker process and found again by later tasks under ``name``."""
    memory = sys.modules.setdefault("_shelfscope_kept", types.ModuleType("_shelfscope_kept")).__dict__
    if name not in memory:
        memory[name] = build()
    return memory[name]


def given_back() -> None:
    """Return to the system what a task has freed: a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only some C libraries have it
        pass


def free(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to be none of ``columns`` (the case of letters does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


Scan = Callable[[pa.Array], dict[str, pa.Array | np.ndarray | list]]


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``size`` bytes together."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + size, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def scan(
    df: DataFrame,
    keep: list[str],
    text: str,
    results: T.StructType,
    make: Callable[[], Scan],
    kind: str = "string",
    size: int = SLICE_BYTES,
) -> DataFrame:
    """``keep`` columns of every row next to what a scan of its text gives.

    ``make`` runs once per task and returns the function from an array of texts
    to the result columns, so that automata and tables are built once.
    """
    kept = [df.schema[name] for name in keep]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept], *results.fields])
    arrow = to_arrow_schema(schema)
    last = len(keep)
    # A text that is kept as it is goes to Python once.
    at = keep.index(text) if text in keep and kind == "string" and df.schema[text].dataType == T.StringType() else last

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for batch in batches:
            for part in slices(batch, at, size):
                found = run(part.column(at))
                columns = [part.column(i) for i in range(last)] + [found[f.name] for f in results.fields]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)],
                    schema=arrow,
                )
                del found, columns
        given_back()

    chosen = [F.col(f"`{name}`") for name in keep]
    if at == last:
        chosen.append(F.col(f"`{text}`").cast(kind).alias(free("__text", keep)))
    return df.select(*chosen).mapInArrow(work, schema)


Emit = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def emitted(df: DataFrame, keep: list[str], text: str, schema: T.StructType, make: Callable[[], Emit]) -> DataFrame:
    """Any number of rows per slice: ``make()`` gives a generator over slices whose last column is the text."""
    last = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for batch in batches:
            for part in slices(batch, last):
                yield from run(part)
        given_back()

    chosen = [F.col(f"`{name}`") for name in keep] + [F.col(f"`{text}`").cast("string").alias(free("__text", keep))]
    return df.select(*chosen).mapInArrow(work, schema)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
