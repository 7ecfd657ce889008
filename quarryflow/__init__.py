"""quarryflow: data jobs for analytics and corpus preparation, as plain functions over Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

__all__ = ["ship"]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of ``spark`` (once per application), for jobs with Python functions."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-quarryflow-"), "quarryflow_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
