"""File trees, file contents and snapshots."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run.

    Only the tree source and content hashing run Python on executors.
    """
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if any(os.path.basename(path) == "samebytes.zip" for path in context.listFiles):
        return
    # Spark copies the archive to the executors; the driver's copy may be local.
    archive = os.path.join(tempfile.mkdtemp(prefix="samebytes-"), "samebytes.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
