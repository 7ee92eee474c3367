"""Scratch folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; below one of our own only where none is set and all run in this process.  Deleted at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="tidemark-")
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def drop_scratch() -> None:
    while _MADE:
        spark, path = _MADE.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
