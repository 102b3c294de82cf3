"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app_name: str = "tickforge",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution and UTC; on a cluster leave ``master`` unset."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # jobs with many stages outgrow the default of 100 compiled stages and compile them anew
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", "8g")
                   .config("spark.driver.host", "127.0.0.1")
                   .config("spark.driver.bindAddress", "127.0.0.1"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
