"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where none is configured and the master is local (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/orderlake"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the interpreter ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
