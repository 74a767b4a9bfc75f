"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``; any path that Spark's readers know."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly, three partitions a core at least, for costly work on rows. The number of partitions of files says nothing of that: a row group is not split, so most of them may be empty and a few tasks would do all."""
    least = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, df.rdd.getNumPartitions()))
