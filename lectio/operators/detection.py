"""Moment detection on a time line: frame channels, gap channel, events (D-20, W-04, W-05, J-11, U-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions import ids
from lectio.functions import text as tx
from lectio.operators import scan
from lectio.operators.joins import as_of_forward
from lectio.sources.shared import written_once


def frame_pairs(frames: DataFrame, lecture: str) -> DataFrame:
    """W-04: consecutive slide readings with text_overlap (1 if both are empty) and added_words.

    The words are written once, as the scan reads them for its segments and for what it carries between them; the text isn't passed on.
    """
    read = written_once(frames.select(*(c for c in frames.columns if c != "text"), tx.content_words("text").alias("words")), "frame-words")
    both = scan.scan(read, [lecture], ["time"], before=scan.lag("words"), apart=scan.lag("time")).where("before IS NOT NULL").withColumn("apart", F.col("time") - F.col("apart"))
    return both.withColumn("text_overlap", tx.jaccard(F.col("words"), F.col("before"), 1.0)).withColumn("added_words", F.size(F.array_except("words", "before")))


def visual_events(pairs: DataFrame, overlap_below: float = 0.55, at_least: int = 3) -> DataFrame:
    """D-20: the first channel in order that matches a pair; pairs without a match are left out."""
    some = (F.size("words") > 0) | (F.size("before") > 0)
    channel = F.when(some & (F.col("text_overlap") < overlap_below), "slide_turnover").when(F.col("added_words") >= at_least, "added_words")
    return pairs.withColumn("channel", channel).where("channel IS NOT NULL")


def events(frames: DataFrame, gaps: DataFrame, lecture: str, horizon: float = 12.0, **channels) -> DataFrame:
    """Candidate events without numbers: visual ones with the gap after them, and gaps that no visual event claimed."""
    seen = visual_events(frame_pairs(frames, lecture), **channels).select(lecture, F.col("time").alias("t"), "channel", F.round("text_overlap", 3).alias("text_overlap"), "added_words")
    seen = written_once(seen, "visual-events")  # both sides of the next join
    visual = as_of_forward(seen.withColumn("k", F.concat_ws("|", "t", "channel")), gaps, lecture, ["k"], "t", horizon).drop("k")
    visual = visual.withColumn("gap_after", F.coalesce(F.round(F.col("gap_end") - F.col("gap_start"), 2), F.lit(0.0))).withColumn("visual", F.lit(True))
    visual = written_once(visual, "visual-gaps")
    claimed = visual.where("gap_start IS NOT NULL").select(lecture, F.round("gap_start", 2).alias("g")).distinct()
    free = gaps.withColumn("g", F.round("start", 2)).join(claimed, [lecture, "g"], "left_anti")
    silent = free.select(lecture, F.col("start").alias("t"), F.lit("speech_gap").alias("channel"), F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), F.round(F.col("end") - F.col("start"), 2).alias("gap_after"), F.lit(False).alias("visual"))
    return visual.unionByName(silent, allowMissingColumns=True)


def detect(frames: DataFrame, gaps: DataFrame, lecture: str, horizon: float = 12.0, **channels) -> DataFrame:
    """The candidate :func:`events`, numbered from 1 within the lecture by (t, channel); ids say which kind an event is."""
    found = events(frames, gaps, lecture, horizon, **channels)
    cuts = scan.bounds(frames, [lecture, "time"], int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scan.scan(found, [lecture], ["t", "channel"], cuts=cuts, number=scan.number()).withColumn("id", ids.moment_id(F.col(lecture).cast("string"), F.col("number"), ~F.col("visual")))


def channel_summary(events: DataFrame, channels: tuple[str, ...] = ("slide_turnover", "added_words", "pixel_motion", "speech_gap")) -> DataFrame:
    """A-17: counts per known channel (0 where there are none), and visual events without a gap."""
    counts = [F.count_if(F.col("channel") == c).alias(c) for c in channels]
    return events.agg(*counts, F.count_if(F.col("visual") & F.col("gap_start").isNull()).alias("visual_without_gap"))


def motion_verdict(hot_cells) -> F.Column:
    """D-27: still, pointer, or content by the number of cells that changed."""
    c = F.col(hot_cells) if isinstance(hot_cells, str) else hot_cells
    return F.when(c == 0, "still").when(c <= 6, "pointer").otherwise("content")


def renders_cursor(probes: DataFrame, lecture: str, minimum: int = 20, share: float = 0.05) -> DataFrame:
    """A-31: too few samples, or a pointer often enough."""
    return probes.groupBy(lecture).agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "pointer").cast("double")).alias("pointer_share")).withColumn("renders_cursor", (F.col("n") < minimum) | (F.col("pointer_share") >= share))
