"""Folders that driver and executors share, for what a scan or a query puts down between two jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in one of this machine only where that is unset and the session
    runs here alone, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="curatrix-"))
            atexit.register(_LOCAL[0].cleanup)
        base = _LOCAL[0].name
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
