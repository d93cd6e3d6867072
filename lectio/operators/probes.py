"""Pointer probes over pictures (M-05, W-17, W-18): cell differences in Arrow batches, all else in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
CELL = 16
HOT = 25.0
LAYOUT_SHARE = 0.60
#: Pairs of pictures that are unpacked at a time.
PICTURES = 256


def cell_deltas(first: bytes, second: bytes, width: int, cell: int = CELL) -> np.ndarray:
    """M-05: mean absolute difference of two grey pictures by whole squares of ``cell`` pixels (rows x columns)."""
    a, b = (np.frombuffer(x, np.uint8).astype(np.int16).reshape(-1, width) for x in (first, second))
    rows, columns = a.shape[0] // cell, width // cell
    apart = np.abs(a - b)[: rows * cell, : columns * cell]
    return apart.reshape(rows, cell, columns, cell).mean(axis=(1, 3))


def covered_cells(width: int, height: int, box: tuple[int, int, int, int], cell: int = CELL) -> list[int]:
    """M-05: numbers (row by row) of the cells that a burned-in clock at (left, top, right, bottom) touches."""
    columns, rows = width // cell, height // cell
    left, top, right, bottom = box
    inside = lambda i, low, high: i * cell < high and (i + 1) * cell > low
    return [r * columns + c for r in range(rows) for c in range(columns) if inside(r, top, bottom) and inside(c, left, right)]


def frame_deltas(frames: DataFrame, lecture: str, time: str, picture: str, width: int, cell: int = CELL) -> DataFrame:
    """(lecture, time, cell, delta): what changed in each cell since the frame before; pictures of another size than that are left out."""
    order = Window.partitionBy(lecture).orderBy(time)
    pairs = frames.select(lecture, time, F.lag(picture).over(order).alias("_before"), F.col(picture).alias("_now")).where("_before IS NOT NULL AND octet_length(_before) = octet_length(_now)")
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, PICTURES) for whole in batches for k in range(0, whole.num_rows, PICTURES)):
            found = [cell_deltas(a, b, width, cell).ravel() for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], [lecture, time, "deltas"])

    measured = pairs.mapInArrow(run, f"{lecture} {kinds[lecture]}, {time} {kinds[time]}, deltas array<double>")
    return measured.select(lecture, time, F.posexplode("deltas").alias("cell", "delta"))


def layout_cells(deltas: DataFrame, lecture: str, share: float = LAYOUT_SHARE, hot: float = HOT) -> DataFrame:
    """W-18: (lecture, cell) of cells that are hot in at least ``share`` of the lecture's frame pairs."""
    return deltas.groupBy(lecture, "cell").agg(F.avg((F.col("delta") > hot).cast("double")).alias("share")).where(F.col("share") >= share).select(lecture, "cell")


def probe(deltas: DataFrame, masked: DataFrame, lecture: str, unit: list[str], time: str, hot: float = HOT) -> DataFrame:
    """W-17: per unit the most hot cells of any frame pair, the peak, and the strongest cell of that pair.

    Cells of ``masked`` (lecture, cell) count as unchanged. Of pairs with as many hot cells the first counts.
    """
    seen = deltas.join(masked.withColumn("_masked", F.lit(True)), [lecture, "cell"], "left").withColumn("delta", F.when(F.col("_masked"), 0.0).otherwise(F.col("delta")))
    per_pair = seen.groupBy(*unit, time).agg(F.count_if(F.col("delta") > hot).alias("hot"), F.max("delta").alias("peak"), F.max(F.struct("delta", (-F.col("cell")).alias("back"))).alias("top"))
    best = F.max(F.struct("hot", (-F.col(time)).alias("early"), (-F.col("top.back")).alias("cell")))
    out = per_pair.groupBy(*unit).agg(best.alias("b"), F.max("peak").alias("peak_delta"), F.count("*").alias("pairs"))
    return out.select(*unit, F.col("b.hot").alias("hot_cells"), "peak_delta", "pairs", F.when(F.col("b.hot") > 0, F.col("b.cell")).alias("at_cell"))
