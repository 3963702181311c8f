"""The folder that driver and executors share, for tables that a flow writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Rows a task where each becomes a record of some kilobytes, so that what a task reads or keeps is bounded by tens of megabytes.
TASK_ROWS = 10_000

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder named by spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="intakespark-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        root = _own[app]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a number of rows: one a core at least, and as many as hold ``TASK_ROWS`` each."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
