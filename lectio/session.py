"""Sessions with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold anywhere; sizes are Spark's defaults, so that a cluster's own values stay.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = 8, partitions: int = 8, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lectio")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("LECTIO_DRIVER_MEMORY", "8g")} | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
