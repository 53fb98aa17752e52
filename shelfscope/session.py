"""Session settings and the one place where lineage is cut.

Intermediate tables that are read more than once (group statistics, exploded
offers, clustering rounds) are written as parquet to the folder the cluster
names in ``spark.checkpoint.dir``.  That survives the loss of executors, keeps
column pruning, and gives the planner true sizes, so a later join broadcasts
such a table only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHUFFLE_PARTITIONS = 8


def local_session(cores: int | str = "*", app: str = "shelfscope") -> SparkSession:
    """A single-machine session for tests and the bench.

    On a cluster the session comes from spark-submit; nothing here is needed.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(LOCAL_SHUFFLE_PARTITIONS))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # No call-site capture for every column expression: plans here are long.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_local_folder: str | None = None
_open_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open_scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: the cluster's setting, else a local one."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="shelfscope-")
    return _local_folder


def materialise(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Inside :func:`intermediates` the table is deleted when the block ends, or
    with the block around it if it ``outlives`` the inner one; outside it stays
    as long as the folder does, because results that are still lazy read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    scopes = _open_scopes.get()
    if outlives:
        scopes = scopes[:-1]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A job's own intermediate tables: deleted at its end, also when it fails.

    Results must be written before the block ends.  Jobs side by side, and a job
    within a job, each delete their own tables only.
    """
    paths: list[str] = []
    token = _open_scopes.set((*_open_scopes.get(), paths))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
