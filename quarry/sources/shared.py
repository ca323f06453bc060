"""The folder that driver and executors share, tables written there, and this package on the workers."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block; the session's own comes back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def until_end(spark: SparkSession, path: str) -> None:
    """Delete a path that exists in the shared folder when the application ends, unless it is gone by then."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for what several branches of a plan read; it goes when the application ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    until_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts and files go to Python in batches of 4 MB at most (one row at least), so a worker's memory doesn't follow the rows' number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it themselves: by PYTHONPATH, or in the working folder."""
    root = Path(__file__).resolve().parents[2]
    near = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if root not in near and app not in _shipped:
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='quarry-')}/quarry", "zip", root, "quarry"))
        _shipped.add(app)
