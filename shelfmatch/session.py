"""The package on the executors, whatever their Python path is."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_given: set[str] = set()


def give_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; tasks that run its Python code need it."""
    sc = spark.sparkContext
    if sc.applicationId in _given:
        return
    _given.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="sources-"), f"{root.name}-sources.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
