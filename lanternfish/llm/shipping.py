"""Python code of this package for the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_lanternfish_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="run-")
    context.addPyFile(shutil.make_archive(f"{folder}/lanternfish", "zip", root, "lanternfish"))
    context._lanternfish_shipped = True
