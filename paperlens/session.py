"""Session defaults for local runs and tests; a cluster keeps its own settings."""

import os

from pyspark.sql import SparkSession


def local_session(cpus="*", shuffle_partitions=8, memory="16g"):
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paperlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
