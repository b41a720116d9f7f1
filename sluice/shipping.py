"""Sends this package to the executors, whose Python workers import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per Spark application: the package's sources as a zip file, which the driver serves to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_sluice_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(home):  # else it came from such a zip itself
        path = os.path.join(tempfile.mkdtemp(prefix="sluice-code-"), "sluice_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(home):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("sluice", os.path.relpath(full, home)))
        sc.addPyFile(path)
    sc._sluice_shipped = True
