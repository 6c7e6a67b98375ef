"""Session construction: one place for the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and AQE are required for right results and plans; the rest are defaults a cluster may override.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` wins over them. On a cluster leave `master` unset."""
    builder = SparkSession.builder.appName("quillspark")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
