"""Cutting the lineage of iterative plans, and the folder for what is written meanwhile."""
from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A folder of ours that all executors share, in that of spark.checkpoint.dir.

    Where the setting is absent a local session gets a folder of its own; a cluster has to name a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodeweave"


#: Folders of tables that this driver's results still stand on; they go when it ends.
_LEFT: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession() if _LEFT else None
    if spark is not None:
        for path in _LEFT:
            with suppress(Exception):  # the session may have ended before
                _remove(spark, path)


def cut(df: DataFrame, *instead: DataFrame) -> DataFrame:
    """df from a Parquet table in the shared folder: computed once, and read again by whatever executor is left.

    instead: frames that cut() gave and that nothing reads once df is written; their tables are deleted. What else is
    left goes when the driver ends."""
    spark = df.sparkSession
    base = f"{folder(spark)}/cut-{spark.sparkContext.applicationId}"
    _LEFT.add(base)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    dropped(*instead)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodeweave_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables of frames that cut() gave."""
    for f in frames:
        path = f.__dict__.pop("_lodeweave_path", None)
        if path:
            _remove(f.sparkSession, path)
