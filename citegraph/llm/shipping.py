"""The package's modules on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import citegraph

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application.

    Executors need not share a folder with the driver: Spark serves the file to them.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(citegraph.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="citegraph-"), "citegraph_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    package.write(file, os.path.relpath(file, os.path.dirname(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
