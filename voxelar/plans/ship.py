"""Sending the package to Python workers that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the application's Python files once, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        target = os.path.join(tempfile.mkdtemp(prefix="voxelar-"), "voxelar.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "voxelar")):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(target)
        _SENT.add(app)
    return spark
