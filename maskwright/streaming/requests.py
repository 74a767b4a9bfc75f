"""A stream of request bodies, dealt to those that can be served and those that are refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.sources.requests import MOST_BYTES, decoded


def serve(
    bodies: DataFrame, out: str, state: str, required: tuple[str, ...], optional: tuple[str, ...] = (), body: str = "body", most_bytes: int = MOST_BYTES, then: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Start a stream that reads all there is, decodes the bodies (see ``sources.requests.decoded``) and writes each row once.

    A micro-batch is one job that writes its good and its refused rows below
    ``out/batch=<id>``, apart by the partition ``refused``, and replaces what
    that folder holds. A batch that comes again after a restart, because the
    driver went down before its end was noted in ``state``, has the same id
    and the same rows, so nothing is there twice, and no row is lost. Bodies
    are not written but for the decoded fields: a refused row keeps its other
    columns and ``error``. ``then`` is called with the id after each write.

    Both folders are on a file system that the driver and all executors see;
    the number of folders grows with the micro-batches, which a trigger sets.
    """

    def write(rows: DataFrame, batch: int) -> None:
        found = decoded(rows, required, optional, body, most_bytes).drop(body).withColumn("refused", F.col("error").isNotNull())
        found.write.mode("overwrite").partitionBy("refused").parquet(f"{out}/batch={batch}")
        if then is not None:
            then(batch)

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def served(spark: SparkSession, out: str, columns: str, refused: bool | None = False) -> DataFrame:
    """What ``serve`` wrote: ``columns`` (a schema), ``error``, ``batch`` and ``refused``; the good rows, the refused ones, or (None) both. A file of the other part is not read."""
    rows = spark.read.schema(f"{columns}, error string, refused boolean, batch int").parquet(out)
    return rows if refused is None else rows.where(F.col("refused") == refused)
