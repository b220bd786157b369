"""Paths for files that a query writes and reads back: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir; a temporary one only where that is unset under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        found = _own[app]
    return f"{found.rstrip('/')}/scratch"


def path(spark: SparkSession, label: str) -> str:
    """A fresh path in it."""
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all files of this kind; call it when no result is lazy any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
