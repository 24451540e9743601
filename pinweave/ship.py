"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per application: the driver serves a zip of the package to every executor, later ones included."""
    context = spark.sparkContext
    if getattr(context, "_pinweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # read by the driver's own file server, for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "pinweave.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(str(path))
    context._pinweave_shipped = True
