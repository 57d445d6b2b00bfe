"""Session helpers: shipping the package to executors and finding the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per Spark application.

    The package is zipped into the driver's temporary folder and served to the executors by Spark itself,
    so nothing depends on a folder that driver and executors share.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quirefold-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "quirefold_pkg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir. Where that is unset, a folder of our own on a local master, whose
    nodes are one; elsewhere executors would write where the driver can't read, so that is refused."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="quirefold-shared-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        current = own
    return (current if "://" in current or current.startswith("file:") else f"file://{current}").rstrip("/")
