"""Tables written once and read again, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if re.fullmatch(r"local(\[.*\])?", context.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectio-"))
    return context.getCheckpointDir().rstrip("/")


def written_once(df: DataFrame, name: str, where: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under ``where`` (by default a new place in the shared folder) and read it again."""
    spark = df.sparkSession
    path = f"{where.rstrip('/')}/{name}" if where else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
