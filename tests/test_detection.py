"""Detection: texts are read once, and counts of channels need no numbers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectio.operators import detection


def tables(spark, n=400):
    rng = random.Random(5)
    words = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    rows = [(k % 3, float(k), " ".join(rng.sample(words, 9))) for k in range(n)]
    frames = spark.createDataFrame(rows, "lecture long, time double, text string")
    gaps = spark.createDataFrame([(k % 3, k + 0.25, k + 0.75) for k in range(0, n, 7)], "lecture long, start double, end double")
    return frames, gaps


def test_texts_are_read_once(spark):
    frames, gaps = tables(spark)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    summary = detection.channel_summary(detection.events(frames.withColumn("text", counted("text")), gaps, "lecture")).collect()
    assert read.value == frames.count()
    assert summary == detection.channel_summary(detection.detect(frames, gaps, "lecture")).collect()


def test_numbered_events_are_the_events(spark):
    frames, gaps = tables(spark)
    columns = ["lecture", "t", "channel", "text_overlap", "added_words", "gap_start", "gap_end", "gap_after", "visual"]
    plain = sorted(detection.events(frames, gaps, "lecture").select(*columns).collect(), key=str)
    numbered = detection.detect(frames, gaps, "lecture").select("number", *columns).orderBy("lecture", "t", "channel").collect()
    assert sorted((tuple(r)[1:] for r in numbered), key=str) == [tuple(r) for r in plain]
    seen = {}
    for r in numbered:
        seen[r.lecture] = seen.get(r.lecture, 0) + 1
        assert r.number == seen[r.lecture]
