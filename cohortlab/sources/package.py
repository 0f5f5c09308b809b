"""Sends this package to the executors, whose functions are pickled by reference."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: a zip of the package, which Spark gives to every executor."""
    if spark.sparkContext.applicationId in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="cohortlab-"), "cohortlab_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(ROOT, "cohortlab")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, ROOT))
        extra = os.path.join(ROOT, "corpus_pipeline.py")
        if os.path.exists(extra):
            z.write(extra, "corpus_pipeline.py")
    spark.sparkContext.addPyFile(path)
    _sent.add(spark.sparkContext.applicationId)
