"""What a session needs before queries run: this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_batchlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        archive = os.path.join(tempfile.mkdtemp(prefix="batchlens-zip-"), "batchlens.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(archive)
    context._batchlens_shipped = True
