"""Loading of the tables a query names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """`df`, or where its scan has fewer splits than twice the cores (a small table is often a single row group, which one task would read),
    its rows dealt over the cores by `key`. A table with enough splits isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def dealt_by_size(df: DataFrame, key: str, part_bytes: int = 8 << 20) -> DataFrame:
    """`df`, a scan of files, dealt by `key` into parts of about `part_bytes` of the files, and over all cores at least. Windows and groups by `key`
    need no other shuffle, and what a task sorts doesn't grow with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes)), key)
