"""Executors need no copy of the package: every query runs with workers that cannot import it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from pyspark.sql import types as T
from shelfscope.session import local_session
from shelfscope.llm import catalog
spark = local_session(4)
spark.sparkContext.setLogLevel("ERROR")

def absent(batches):
    import importlib.util
    assert importlib.util.find_spec("shelfscope") is None
    yield from batches

spark.range(1).mapInArrow(absent, "id long").collect()
for name, query in catalog.QUERIES.items():
    print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_queries_without_the_package_on_workers(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    own = [x for x in os.environ.get("PYTHONPATH", "").split(":") if x and Path(x).resolve() != Path(root)]
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env | {"PYTHONPATH": ":".join(own)}, capture_output=True, text=True, timeout=1200
    )
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.count("\n") >= 13
