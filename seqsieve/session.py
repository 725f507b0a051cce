"""What the engine asks of a Spark session: a shared folder, and itself on the workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, shared by all executors.

    Only a local session, where one machine runs everything, may fall back to a
    temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="seqsieve-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/seqsieve-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``scratch_folder`` gave and nothing reads any more."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver imported it from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = f"{tempfile.mkdtemp(prefix='seqsieve-')}/{package.name}"
    context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
