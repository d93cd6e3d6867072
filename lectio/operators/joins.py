"""Join shapes on keys and times (J-01 to J-22).

Range conditions become equi-joins: time is cut into buckets, an interval stands in each bucket it
touches, and a point in its own. No join is a product of two tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.operators import scan


def range_join(points: DataFrame, spans: DataFrame, key: list[str], t: str, low: Column, high: Column, width: float, closed: bool = True) -> DataFrame:
    """Points joined with the spans of the same key that hold their time ``t`` (J-06, J-09).

    ``low`` and ``high`` are columns of ``spans``; ``width`` is about the spans' length.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    left = spans.withColumn("_low", low).withColumn("_high", high).withColumn("_b", F.explode(F.sequence(bucket(F.col("_low")), F.greatest(bucket(F.col("_low")), bucket(F.col("_high"))))))
    right = points.withColumn("_b", bucket(F.col(t))).withColumnRenamed(t, "_t")
    inside = (F.col("_t") >= F.col("_low")) & ((F.col("_t") <= F.col("_high")) if closed else (F.col("_t") < F.col("_high")))
    found = left.join(right, [*key, "_b"]).where(inside).withColumnRenamed("_t", t).drop("_b")
    return found.drop("_low", "_high")


def as_of_forward(events: DataFrame, gaps: DataFrame, key: str, event_id: list[str], t: str, horizon: float = 12.0, tolerance: float = 0.5) -> DataFrame:
    """J-05: each event with the first gap that starts between t - tolerance and t + horizon; null if none."""
    spans = events.select(key, *event_id, t)
    found = range_join(gaps.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")).withColumnRenamed("_s", "gap_start"), spans, [key], "gap_start", F.col(t) - tolerance, F.col(t) + horizon, horizon + tolerance)
    first = found.groupBy(key, *event_id).agg(F.min(F.struct("gap_start", F.col("_e").alias("gap_end"))).alias("g"))
    return events.join(first.select(key, *event_id, "g.gap_start", "g.gap_end"), [key, *event_id], "left")


def longest_pause(events: DataFrame, gaps: DataFrame, key: str, event_id: list[str], t: str, horizon: float = 12.0, tolerance: float = 0.5) -> DataFrame:
    """J-10: the longest gap that starts in the window, 0 if none; two digits."""
    found = range_join(gaps.select(key, F.col("start").alias("gap_start"), (F.col("end") - F.col("start")).alias("_len")), events.select(key, *event_id, t), [key], "gap_start", F.col(t) - tolerance, F.col(t) + horizon, horizon + tolerance)
    most = found.groupBy(key, *event_id).agg(F.max("_len").alias("_pause"))
    return events.join(most, [key, *event_id], "left").withColumn("pause_after", F.round(F.coalesce("_pause", F.lit(0.0)), 2)).drop("_pause")


def words_between(words: DataFrame, spans: DataFrame, key: str, span_id: list[str], low: Column, high: Column, width: float = 15.0) -> DataFrame:
    """J-09: the words with low <= start < high in order, joined by spaces; empty if there are none."""
    points = words.select(key, F.col("start").alias("_start"), F.col("text").alias("_word")).withColumnRenamed("_start", "at")
    found = range_join(points, spans, [key], "at", low, high, width, closed=False)
    joined = found.groupBy(key, *span_id).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "_word"))), lambda x: x["_word"]), " ").alias("_text"))
    return spans.join(joined, [key, *span_id], "left").withColumn("transcript_window", F.coalesce("_text", F.lit(""))).drop("_text")


def keyframe_band(moments: DataFrame, frames: DataFrame, key: str, moment: list[str], t: str, before: float, after: float, count: int) -> DataFrame:
    """J-06: the first ``count`` keyframes in [t - before, t + after], as an array of paths."""
    found = range_join(frames.select(key, F.col("time").alias("frame_time"), "path"), moments.select(key, *moment, t), [key], "frame_time", F.col(t) - before, F.col(t) + after, before + after + 1)
    lists = found.groupBy(key, *moment).agg(F.slice(F.sort_array(F.collect_list(F.struct("frame_time", "path"))), 1, count).alias("_fs"))
    return moments.join(lists, [key, *moment], "left").withColumn("keyframes", F.coalesce(F.col("_fs.path"), F.array().cast("array<string>"))).drop("_fs")


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: list[str], t: str, right_t: str, value: str, max_skew: float | None = None) -> DataFrame:
    """J-07, J-08: the value nearest in time, the earlier on a tie; null beyond ``max_skew``.

    Both sides are laid on one time line per key; the neighbours before and after come from a segmented
    scan, so the cost is a sort and a hot key is spread.
    """
    line = left.select(key, *left_id, F.col(t).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("struct<rt:double,v:string>").alias("_r"))
    line = line.unionByName(right.select(key, F.col(right_t).cast("double").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(right_t).cast("double").alias("rt"), F.col(value).cast("string").alias("v")).alias("_r")), allowMissingColumns=True)
    both = scan.scan(line, [key], ["_at", "_side"], _b=scan.last("_r"), _a=scan.following("_r")).where("_side = 1")
    closer = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_at") - F.col("_b.rt") <= F.col("_a.rt") - F.col("_at"), F.col("_b")).otherwise(F.col("_a"))
    picked = both.withColumn("_p", closer)
    near = F.col("_p.v") if max_skew is None else F.when(F.abs(F.col("_p.rt") - F.col("_at")) <= max_skew, F.col("_p.v"))
    return left.join(picked.select(key, *left_id, near.alias(f"nearest_{value}"), F.col("_p.rt").alias("nearest_time")), [key, *left_id], "left")


def complete(contexts: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """J-02: every context, with ``reason`` missing where there is no prediction."""
    return contexts.join(predictions.withColumn("_has", F.lit(True)), key, "left").withColumn("reason", F.when(F.col("_has").isNull(), "missing")).drop("_has")


def resume(items: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """J-17: items without a finished (error-free) answer."""
    return items.join(answers.where("coalesce(error, '') = ''").select(key), key, "left_anti")


def merge_repairs(predictions: DataFrame, repairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """J-16: filled repairs replace unfilled predictions; filled predictions stay."""
    from lectio.functions.text import is_unfilled

    other = repairs.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = predictions.join(other, key, "left")
    take = is_unfilled(columns[0]) & ~is_unfilled(f"_{columns[0]}")
    return joined.withColumns({c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def common_systems(scores: DataFrame, system: str, metric: str, n_metrics: int) -> DataFrame:
    """J-18: systems that every metric scored."""
    return scores.groupBy(system).agg(F.count_distinct(metric).alias("n")).where(F.col("n") == n_metrics).select(system)


def missing_writers(answers: DataFrame, moment: str, writer: str, wanted: list[str]) -> DataFrame:
    """J-22, A-23: per moment the writers that haven't answered; error rows don't count."""
    got = F.collect_set(F.when(F.coalesce(F.col("error"), F.lit("")) == "", F.col(writer)))
    return answers.groupBy(moment).agg(F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), got)).alias("missing"))
