"""What streams need around them: settings that are set back, and tables read as a stream in order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.shared import folder

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(rows: DataFrame, what: str, conf: dict[str, str] | None = None):
    """(what a stream wrote, the query), after it has read all that is there; rows, offsets and state are kept in the shared folder."""
    spark, out = rows.sparkSession, folder(rows.sparkSession, what)
    with settings(spark, conf or {}):
        query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows"), query


def in_order(rows: DataFrame, part: Column, parts: int, files: int = 4) -> DataFrame:
    """A stream of a table's parts 0, 1 ..., each one a micro-batch, as if they had come in one after another."""
    spark, out = rows.sparkSession, folder(rows.sparkSession, "arrivals")
    for i in range(parts):
        rows.where(part == F.lit(i)).repartition(files).write.mode("append").parquet(out)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(out)


def stream_of(written: DataFrame) -> DataFrame:
    """What ``run`` wrote, as the source of another stream."""
    folder_of = written.inputFiles()[0].rsplit("/", 1)[0]
    return written.sparkSession.readStream.schema(written.schema).parquet(folder_of)
