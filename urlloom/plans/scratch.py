"""Where queries write what they read again."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import SparkSession

#: Folders in a local scratch folder, which go when the driver ends; in a shared store the folder's owner decides.
_made: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where none is set and Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing is at yet."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


@atexit.register
def _tidy() -> None:
    for path in _made:
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
