"""Sends this package to the executors, whose Python workers import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip file to the session's application, once."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        tmp = tempfile.mkdtemp(prefix="pagemill-")  # the driver serves the file from here until it ends
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        shutil.copytree(here, f"{tmp}/src/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{tmp}/{here.name}", "zip", f"{tmp}/src"))
        _shipped.add(sc.applicationId)
    return spark
