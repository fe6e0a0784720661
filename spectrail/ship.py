"""Gives the executors this package, for functions that run in their Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the application's Python files, once; workers then need no copy of their own."""
    sc = spark.sparkContext
    top = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _sent or not os.path.isdir(top):
        return
    name = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spectrail-")), "spectrail.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("spectrail", os.path.relpath(full, top)))
    sc.addPyFile(name)
    _sent.add(sc.applicationId)
