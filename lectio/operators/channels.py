"""Detection channels that carry state from row to row, as table functions that SQL can call."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class PixelMotion:
    """W-07: rows of one group in order, read one by one; what is kept is the last picture.

    The input table has claimed, apart and picture; the output has its columns and ``motion``. A claimed pair isn't read; a pair as
    far apart as ``idle`` is declined, and the reference picture forgotten; else the mean difference of the pictures counts where it
    reaches ``threshold``.
    """

    @staticmethod
    def analyze(frames: AnalyzeArgument, threshold: AnalyzeArgument, idle: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name for f in frames.dataType}
        if not {"claimed", "apart", "picture"} <= names or "motion" in names:
            raise ValueError("the table needs claimed, apart and picture, and no motion")
        return AnalyzeResult(schema=StructType([*frames.dataType.fields]).add("motion", DoubleType()))

    def __init__(self):
        self.last = None

    def eval(self, row, threshold: float, idle: float):
        motion = None
        if not row["claimed"]:
            if row["apart"] >= idle:
                self.last = None
            else:
                now = np.frombuffer(bytes(row["picture"]), np.uint8).astype(float)
                if self.last is not None and len(self.last) == len(now):
                    moved = float(np.abs(now - self.last).mean() / 255)
                    motion = moved if moved >= threshold else None
                self.last = now
        yield (*row, motion)


def register(spark: SparkSession) -> None:
    """Names for SQL: ``SELECT * FROM pixel_motion(TABLE(frames) PARTITION BY (lecture) ORDER BY (time), 0.02D, 30D)``."""
    spark.udtf.register("pixel_motion", PixelMotion)


def pixel_motion(rows: DataFrame, lecture: str, threshold: float = 0.02, idle: float = 30.0, time: str = "time") -> DataFrame:
    """W-07 over each lecture's frames in order of time: no task holds more pictures than two."""
    return PixelMotion(rows.asTable().partitionBy(lecture).orderBy(time), F.lit(float(threshold)), F.lit(float(idle)))
