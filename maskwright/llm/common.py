"""What the corpus operators share: shared storage, tables kept between jobs, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []  # the temporary folder of a session without a shared one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset and Spark runs in one process (tests), a temporary one that is set here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='maskwright-')}")
        found = _OWN[0]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; it is deleted when the driver ends."""
    if not _KEPT:
        atexit.register(discard)
    path = f"{shared_dir(spark)}/maskwright/{what}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(there, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder stays
        pass


def discard(spark: SparkSession | None = None) -> None:
    """Delete the folders of ``fresh_path`` (of one session, or of all)."""
    for item in list(_KEPT):
        if spark is None or item[0] is spark:
            _KEPT.remove(item)
            _delete(*item)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of ``keep`` that nothing reads any more; others are passed over."""
    for df in tables:
        path = getattr(df, "kept_at", None)
        item = next((x for x in _KEPT if x[1] == path), None)
        if item:
            _KEPT.remove(item)
            _delete(*item)


def keep(df: DataFrame, what: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends, lost executors cost nothing.

    ``batch_rows``: at most so many rows at once for Python functions in it, where rows are wide.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    if batch_rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def _trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """``run`` for mapInArrow: a worker outlives its stage, so at the end of a partition it gives back what it no longer uses."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 one), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_slices(col: pa.Array, limit: int = 8 << 20, rows: int = 1 << 16):
    """(first row, last row) pairs of an array that hold ``limit`` bytes of text and ``rows`` rows at most, or one row that is longer."""
    _, at = string_bytes(col)
    first = 0
    while first < len(col):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, first + rows, len(col))
        yield first, last
        first = last
