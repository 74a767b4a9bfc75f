"""Error rates over event time, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.shared import folder


def error_rates(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and errors per window; on a stream, with a watermark of ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("error_ratio"))


def streamed(spark: SparkSession, sf_dir: str, width: str) -> DataFrame:
    """The events table read as a stream until it is used up; the table of all windows is written anew after each micro-batch, to files, and its state is kept in the shared folder."""
    root = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    out = folder(spark, "rates")
    query = error_rates(events, width).writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
