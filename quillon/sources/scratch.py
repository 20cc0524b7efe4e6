"""Folders for a stream's state and output, shared by all nodes, deleted when the driver's Python ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_folders: list[tuple[object, object]] = []


def _forget() -> None:
    for path, conf in _folders:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing to delete through
            return


def folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in ``spark.checkpoint.dir``; a local one only where that is unset and Spark is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}/quillon-shared"
    path = f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_forget)
    _folders.append((spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return path
