"""Queries over the time line: gaps, windows, joins in time, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectio.functions import text as tx
from lectio.operators import channels, detection, joins, sequence
from lectio.plans.catalogue import query
from lectio.plans.relations import GAPS, TIMELINE, VIEWS, gaps, table, timeline, views

_BASE = f"{TIMELINE}, {GAPS}, {VIEWS}"


def _speech(spark, sf_dir):
    return timeline(spark, sf_dir).where("event_type = 'click'").select("lecture", F.col("t").alias("start"), F.floor(F.col("t") + F.col("value") * 60).cast("double").alias("end"))


_SPEECH = f"""{TIMELINE}, speech AS (SELECT lecture, t AS start, floor(t + value * 60)::DOUBLE AS "end" FROM timeline WHERE event_type = 'click'),
line AS (SELECT * FROM speech UNION ALL SELECT DISTINCT lecture, 2600000.0, 2600000.0 FROM speech),
silence AS (SELECT lecture, round(f, 2) AS start, round(start, 2) AS "end" FROM (SELECT *, coalesce(max("end") OVER (PARTITION BY lecture ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS f FROM line) WHERE start - f >= 0.5)"""


def _silences(spark, sf_dir):
    speech = _speech(spark, sf_dir)
    return sequence.gaps_between(speech, "lecture", speech.select("lecture").distinct().withColumn("duration", F.lit(2600000.0)))


@query(f'WITH {_SPEECH} SELECT lecture, round(start, 1) AS start, round("end", 1) AS "end" FROM silence')
def speech_gaps(spark, sf_dir):
    """W-06, X-03."""
    return _silences(spark, sf_dir).select("lecture", F.round("start", 1).alias("start"), F.round("end", 1).alias("end"))


@query(f'WITH {_SPEECH} SELECT lecture, count(*) AS n, round(sum("end" - start), 0) AS seconds FROM silence WHERE "end" - start >= 1.5 GROUP BY lecture')
def usable_gaps(spark, sf_dir):
    """PRJ-16, SRC-15."""
    return sequence.usable_gaps(_silences(spark, sf_dir)).groupBy("lecture").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 0).alias("seconds"))


_HORIZON = 3600.0


@query(f"""WITH {_BASE} SELECT v.event_id, min(g.start) AS gap_start, arg_min(g."end", (g.start, g."end")) AS gap_end
FROM views v LEFT JOIN gaps g ON g.lecture = v.lecture AND g.start >= v.t - 0.5 AND g.start <= v.t + {_HORIZON} GROUP BY v.event_id""")
def next_gap_asof(spark, sf_dir):
    """J-05."""
    return joins.as_of_forward(views(spark, sf_dir), gaps(spark, sf_dir), "lecture", ["event_id"], "t", _HORIZON).select("event_id", "gap_start", "gap_end")


@query(f"""WITH {_BASE} SELECT v.event_id, round(coalesce(max(g."end" - g.start), 0.0), 1) AS pause_after
FROM views v LEFT JOIN gaps g ON g.lecture = v.lecture AND g.start >= v.t - 0.5 AND g.start <= v.t + {_HORIZON} GROUP BY v.event_id""")
def pause_after(spark, sf_dir):
    """J-10."""
    found = joins.longest_pause(views(spark, sf_dir), gaps(spark, sf_dir), "lecture", ["event_id"], "t", _HORIZON)
    return found.select("event_id", F.round("pause_after", 1).alias("pause_after"))


def _said(spark, sf_dir):
    return timeline(spark, sf_dir).where("event_type = 'click'").select("lecture", F.col("t").alias("start"), F.concat(F.lit("w"), "event_id").alias("text"))


_SAID = f"{_BASE}, said AS (SELECT lecture, t AS start, 'w' || event_id AS text FROM timeline WHERE event_type = 'click')"


@query(f"""WITH {_SAID} SELECT v.event_id, coalesce(string_agg(s.text, ' ' ORDER BY s.start, s.text), '') AS transcript_window
FROM views v LEFT JOIN said s ON s.lecture = v.lecture AND s.start >= v.t - 5000 AND s.start < v.t + 8000 GROUP BY v.event_id""")
def transcript_window_fixed(spark, sf_dir):
    """J-09, V-22, SRC-14."""
    found = joins.words_between(_said(spark, sf_dir), views(spark, sf_dir), "lecture", ["event_id"], F.col("t") - 5000, F.col("t") + 8000, 13000.0)
    return found.select("event_id", "transcript_window")


@query(f"""WITH {_SAID}, spans AS (SELECT *, lead(t) OVER (PARTITION BY lecture ORDER BY t) AS nx FROM views),
w AS (SELECT event_id, lecture, t - 5000 AS low, CASE WHEN nx > t AND nx < t + 45000 THEN nx ELSE t + 45000 END AS high FROM spans)
SELECT w.event_id, round(low, 2) AS low, round(high, 2) AS high, count(s.text) AS n_words FROM w LEFT JOIN said s ON s.lecture = w.lecture AND s.start >= w.low AND s.start < w.high GROUP BY ALL""")
def transcript_window_next_event(spark, sf_dir):
    """W-11, J-09."""
    spans = sequence.next_event_span(views(spark, sf_dir), "lecture", "t", 5000.0, 45000.0)
    found = joins.words_between(_said(spark, sf_dir), spans, "lecture", ["event_id"], F.col("low"), F.col("high"), 50000.0)
    n = F.when(F.col("transcript_window") == "", 0).otherwise(F.size(F.split("transcript_window", " ")))
    return found.select("event_id", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), n.cast("long").alias("n_words"))


@query(f"""WITH {_BASE}, near AS (SELECT v.event_id, v.t, g.start, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(g.start - v.t), g.start) AS n FROM views v JOIN gaps g USING (lecture))
SELECT v.event_id, CASE WHEN abs(near.start - v.t) <= 20000 THEN round(near.start, 2) END AS nearest FROM views v LEFT JOIN near ON near.event_id = v.event_id AND near.n = 1""")
def nearest_frame(spark, sf_dir):
    """J-07, J-08."""
    frames = gaps(spark, sf_dir).select("lecture", F.col("start").alias("time"), F.round("start", 2).alias("at"))
    found = joins.nearest(views(spark, sf_dir), frames, "lecture", ["event_id"], "t", "time", "at", 20000.0)
    return found.select("event_id", F.col("nearest_at").cast("double").alias("nearest"))


@query(f"""WITH {_BASE}, band AS (SELECT v.event_id, list('f' || (g.start::BIGINT) ORDER BY g.start) AS l FROM views v JOIN gaps g ON g.lecture = v.lecture AND g.start >= v.t - 20000 AND g.start <= v.t + 40000 GROUP BY v.event_id)
SELECT v.event_id, coalesce(array_to_string(list_slice(l, 1, 3), ','), '') AS keyframes FROM views v LEFT JOIN band USING (event_id)""")
def keyframe_band(spark, sf_dir):
    """J-06, PRJ-04, SRC-17."""
    frames = gaps(spark, sf_dir).select("lecture", F.col("start").alias("time"), F.concat(F.lit("f"), F.round("start").cast("long")).alias("path"))
    found = joins.keyframe_band(views(spark, sf_dir), frames, "lecture", ["event_id"], "t", 20000.0, 40000.0, 3)
    return found.select("event_id", F.array_join("keyframes", ",").alias("keyframes"))


def _frames(spark, sf_dir):
    """Documents of a source as the readings of its slides."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("lecture"), F.col("doc_id").cast("double").alias("time"), "text")


_CONTENT = rf"list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']{{2,}}'), lambda x: lower(x))), lambda x: x NOT IN ({', '.join(repr(w) for w in tx.COMMON_WORDS)}))"
_FRAME_PAIRS = f"""frames AS (SELECT source AS lecture, doc_id::DOUBLE AS time, {_CONTENT} AS words FROM documents),
neighbours AS (SELECT *, lag(words) OVER (PARTITION BY lecture ORDER BY time) AS before FROM frames),
fp AS (SELECT lecture, time, len(words) + len(before) AS n, CASE WHEN len(list_distinct(list_concat(words, before))) = 0 THEN 1.0 ELSE len(list_intersect(words, before)) / len(list_distinct(list_concat(words, before)))::DOUBLE END AS text_overlap,
  len(words) - len(list_intersect(words, before)) AS added_words FROM neighbours WHERE before IS NOT NULL),
hits AS (SELECT *, CASE WHEN n > 0 AND text_overlap < 0.55 THEN 'slide_turnover' WHEN added_words >= 3 THEN 'added_words' END AS channel FROM fp)"""


@query(f"WITH {_FRAME_PAIRS} SELECT lecture, time, round(text_overlap, 6) AS text_overlap, added_words FROM fp")
def frame_pairs(spark, sf_dir):
    """W-04, U-07, S-10."""
    return detection.frame_pairs(_frames(spark, sf_dir), "lecture").select("lecture", "time", F.round("text_overlap", 6).alias("text_overlap"), F.col("added_words").cast("long").alias("added_words"))


@query(f"WITH {_FRAME_PAIRS} SELECT lecture, channel, count(*) AS n FROM hits WHERE channel IS NOT NULL GROUP BY ALL")
def frame_channels(spark, sf_dir):
    """D-20."""
    return detection.visual_events(detection.frame_pairs(_frames(spark, sf_dir), "lecture")).groupBy("lecture", "channel").agg(F.count("*").alias("n"))


def _doc_gaps(spark, sf_dir):
    """A gap at each document, whose length in seconds is the thousandth of its characters."""
    d = table(spark, sf_dir, "documents")
    start = F.col("doc_id") + 0.25
    return d.select(F.col("source").alias("lecture"), start.cast("double").alias("start"), (start + F.col("n_chars") / 1000).cast("double").alias("end"))


_DETECT = f"""{_FRAME_PAIRS}, dgaps AS (SELECT source AS lecture, doc_id + 0.25::DOUBLE AS start, doc_id + 0.25 + n_chars / 1000.0 AS "end" FROM documents),
visual AS (SELECT h.lecture, h.time AS t, h.channel, min(g.start) AS gap_start FROM hits h LEFT JOIN dgaps g ON g.lecture = h.lecture AND g.start >= h.time - 0.5 AND g.start <= h.time + 12 WHERE channel IS NOT NULL GROUP BY ALL),
events_ AS (SELECT lecture, t, channel, gap_start, true AS visual FROM visual
  UNION ALL SELECT lecture, start, 'speech_gap', start, false FROM dgaps WHERE (lecture, round(start, 2)) NOT IN (SELECT (lecture, round(gap_start, 2)) FROM visual WHERE gap_start IS NOT NULL)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lecture ORDER BY t, channel) AS number FROM events_)"""


def _detected(spark, sf_dir):
    return detection.detect(_frames(spark, sf_dir), _doc_gaps(spark, sf_dir), "lecture")


@query(f"WITH {_DETECT} SELECT lecture || CASE WHEN visual THEN '#' || lpad(number::VARCHAR, 4, '0') ELSE '#g' || lpad(number::VARCHAR, 3, '0') END AS id, t, channel, gap_start FROM numbered")
def detect_moments(spark, sf_dir):
    """The detector: W-04, W-05, J-05, J-11, U-01, U-02."""
    return _detected(spark, sf_dir).select("id", "t", "channel", "gap_start")


@query(f"WITH {_DETECT} SELECT count(*) FILTER (channel = 'slide_turnover') AS slide_turnover, count(*) FILTER (channel = 'added_words') AS added_words, 0::BIGINT AS pixel_motion, count(*) FILTER (channel = 'speech_gap') AS speech_gap, count(*) FILTER (visual AND gap_start IS NULL) AS visual_without_gap FROM numbered")
def channel_summary(spark, sf_dir):
    """A-17: counts need no numbers, so events are not put in order."""
    return detection.channel_summary(detection.events(_frames(spark, sf_dir), _doc_gaps(spark, sf_dir), "lecture"))


@query(f"WITH {TIMELINE} SELECT event_id, ((row_number() OVER (PARTITION BY lecture ORDER BY t, event_id) - 1) // 10)::INT AS batch FROM timeline")
def batch_by_lecture(spark, sf_dir):
    """D-21, V-08."""
    return sequence.batches(timeline(spark, sf_dir), "lecture", ["t", "event_id"], 10).select("event_id", "batch")


@query("""WITH p AS (SELECT user_id AS lecture, (event_id % 11)::INT AS hot FROM events), v AS (SELECT lecture, CASE WHEN hot = 0 THEN 'still' WHEN hot <= 6 THEN 'pointer' ELSE 'content' END AS verdict FROM p)
SELECT lecture, count(*) AS n, round(avg((verdict = 'pointer')::INT), 6) AS pointer_share, count(*) < 20 OR avg((verdict = 'pointer')::INT) >= 0.05 AS renders_cursor FROM v GROUP BY lecture""")
def cursor_probe(spark, sf_dir):
    """A-31, D-27."""
    probes = table(spark, sf_dir, "events").select(F.col("user_id").alias("lecture"), detection.motion_verdict((F.col("event_id") % 11).cast("int")).alias("verdict"))
    return detection.renders_cursor(probes, "lecture").withColumn("pointer_share", F.round("pointer_share", 6))


@query(f"""WITH {TIMELINE}, ends AS (SELECT lecture, max(t) + 1 AS duration FROM timeline GROUP BY lecture),
marks AS (SELECT lecture, unnest(generate_series(0, floor(duration / 3000)::BIGINT)) * 3000.0::DOUBLE AS x FROM ends UNION SELECT lecture, t FROM timeline WHERE event_type = 'error'),
lists AS (SELECT lecture, list([x] ORDER BY x) AS l FROM marks JOIN ends USING (lecture) WHERE x >= 0 AND x < duration GROUP BY lecture)
SELECT lecture, array_to_string(list_transform(list_reduce(l, lambda kept, one: CASE WHEN one[1] - kept[len(kept)] >= 500 THEN list_concat(kept, one) ELSE kept END), lambda x: x::BIGINT::VARCHAR), ',') AS times FROM lists""")
def keyframe_times(spark, sf_dir):
    """W-08: the scene times of each user's errors, up to the second of the user's last event."""
    events = timeline(spark, sf_dir)
    scene = F.when(F.col("event_type") == "error", F.col("t"))
    scenes = events.groupBy("lecture").agg((F.max("t") + 1).alias("duration"), F.sort_array(F.collect_list(scene)).alias("scenes"))
    return scenes.select("lecture", F.array_join(F.transform(sequence.keyframe_times(F.col("duration"), F.col("scenes"), 3000.0, 500.0), lambda x: x.cast("long").cast("string")), ",").alias("times"))


@query(f"""WITH RECURSIVE {TIMELINE}, shown AS (SELECT lecture, event_type = 'error' AS claimed, value AS apart, (event_id * 37) % 256 AS grey, row_number() OVER (PARTITION BY lecture ORDER BY t, event_id) AS n FROM timeline),
walk AS (SELECT lecture, n, CASE WHEN NOT claimed AND apart < 90 THEN grey END AS last, NULL::DOUBLE AS motion FROM shown WHERE n = 1
  UNION ALL SELECT s.lecture, s.n, CASE WHEN s.claimed THEN w.last WHEN s.apart >= 90 THEN NULL ELSE s.grey END,
    CASE WHEN NOT s.claimed AND s.apart < 90 AND abs(s.grey - w.last) / 255.0 >= 0.02 THEN abs(s.grey - w.last) / 255.0::DOUBLE END FROM walk w JOIN shown s ON s.lecture = w.lecture AND s.n = w.n + 1)
SELECT lecture, count(motion) AS hits, round(avg(motion), 6) AS mean FROM walk GROUP BY lecture""")
def pixel_motion(spark, sf_dir):
    """W-07: a picture of four bytes of one grey value per event."""
    line = timeline(spark, sf_dir)
    grey = F.lpad(F.hex(F.col("event_id") * 37 % 256), 2, "0")
    rows = line.select("lecture", F.struct("t", "event_id").alias("time"), (F.col("event_type") == "error").alias("claimed"), F.col("value").alias("apart"), F.unhex(F.repeat(grey, 4)).alias("picture"))
    return channels.pixel_motion(rows, "lecture", idle=90.0).groupBy("lecture").agg(F.count("motion").alias("hits"), F.round(F.avg("motion"), 6).alias("mean"))
