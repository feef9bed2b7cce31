"""Paths for tables that a run writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder of our own only where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="ledgerlens-index-"))
        base = _own[0]
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}/{name}"
