"""Sends the package to executors whose Python doesn't have it."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's files, once; Spark serves it to every executor."""
    context = spark.sparkContext
    if getattr(context, "_tracemill_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp(prefix='tracemill-')}/tracemill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    context._tracemill_shipped = True
