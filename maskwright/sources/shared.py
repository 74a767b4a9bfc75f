"""The folder that the driver and all executors share: tables kept between jobs, checkpoints of streams."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []  # the temporary folder of a local session without a shared one
_MADE: list[tuple[SparkSession, str]] = []  # what ``folder`` gave out and ``discard`` has not deleted


def folder(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset and Spark runs in one process (tests), below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='maskwright-')}")
        root = _OWN[0]
    if not _MADE:
        atexit.register(discard)
    path = f"{root.rstrip('/')}/maskwright/{what}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(there, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder stays
        pass


def discard(spark: SparkSession | None = None) -> None:
    """Delete what ``folder`` gave out (to one session, or to all); it may hold texts and originals. The end of the driver does so too."""
    for item in list(_MADE):
        if spark is None or item[0] is spark:
            _MADE.remove(item)
            _delete(*item)


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` worked out once: written to the shared folder and read again; ``discard`` deletes it."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
