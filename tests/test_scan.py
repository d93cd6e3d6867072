"""The segmented scan against plain windows, whatever the number of segments."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectio.operators import scan


def made(spark, hot: bool, n: int = 400):
    rng = random.Random(5)
    rows = [("hot" if hot or k % 3 == 0 else rng.choice(["a", "b", "c", None]), float(rng.randint(0, 90)), k, rng.choice([None, rng.randint(-9, 9)])) for k in range(n)]
    return spark.createDataFrame(rows, "g string, t double, id long, v int")


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("parts", [1, 3, 16])
def test_steps_equal_windows(spark, hot, parts):
    rows = made(spark, hot)
    got = scan.scan(
        rows, ["g"], ["t", "id"], parts, n=scan.number(), before=scan.lag("v"), after=scan.lead("v"), s=scan.sum_before("v"), m=scan.max_before("v"), known=scan.last("v"), soon=scan.following("v")
    )
    w = Window.partitionBy("g").orderBy("t", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    expected = rows.withColumns(
        {
            "n": F.row_number().over(w), "before": F.lag("v").over(w), "after": F.lead("v").over(w), "s": F.sum("v").over(before), "m": F.max("v").over(before),
            "known": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "soon": F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    assert got.columns == expected.columns
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(expected.collect(), key=lambda r: r.id)


def test_a_hot_group_is_spread_evenly(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") % 977).cast("double").alias("t"), "id")
    seen = scan.scan(rows, ["g"], ["t", "id"], 8, n=scan.number()).groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in seen)
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_empty_rows(spark):
    rows = spark.createDataFrame([], "g string, t double")
    assert scan.scan(rows, ["g"], ["t"], 4, n=scan.number(), b=scan.lag("t")).collect() == []
