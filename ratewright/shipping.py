"""Brings this package to the Python workers, wherever they run and whatever folder they start in."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a ZIP file that Spark hands to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ratewright-"), "ratewright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith((".py", ".json")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ratewright", os.path.relpath(full, top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`f`, whose first argument is the session, with the package at its workers."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args: object, **named: object) -> DataFrame:
        ship(spark)
        return f(spark, *args, **named)

    return run
