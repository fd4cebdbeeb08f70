"""Sends the package to executors that have no copy of it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application; the driver serves the file."""
    sc = spark.sparkContext
    if sc.applicationId not in _done:
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='corvid-')}/corvid", "zip", root, "corvid"))
        _done.add(sc.applicationId)
