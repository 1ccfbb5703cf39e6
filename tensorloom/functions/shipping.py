"""Sends this package to the executors, for sessions that were started without it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    at = os.path.join(tempfile.mkdtemp(prefix="tensorloom-"), "tensorloom.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_ROOT)))
    context.addPyFile(at)
