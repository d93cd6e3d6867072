"""The driver's tables in the roles of the lecture domain, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio.functions.scoring import MOMENT_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as described moments: the turn before is the slide, the one after is said."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    kinds = F.array(*map(F.lit, MOMENT_TYPES))
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("conv-"), "conv_id").alias("lecture"),
        F.format_string("conv-%d#%04d", "conv_id", "turn").alias("moment_id"),
        "conv_id",
        "turn",
        (F.col("turn") * 20.0).alias("t"),
        F.element_at(kinds, (F.col("turn") % 12 + 1).cast("int")).alias("type"),
        F.col("role").alias("system"),
        F.col("text").alias("ad_text"),
        F.lag("text").over(w).alias("slide_ocr"),
        F.lit(None).cast("string").alias("what_on_screen"),
        F.lead("text").over(w).alias("transcript_window"),
        ((F.col("conv_id") * 7 + F.col("turn") * 3) % 25 / 2.0).alias("pause_after"),
        F.when(F.col("conv_id") % 3 == 0, True).when(F.col("conv_id") % 3 == 1, False).alias("renders_cursor"),
    )


_KINDS = ", ".join(f"'{k}'" for k in MOMENT_TYPES)
MOMENTS = f"""moments AS (
SELECT 'conv-' || conv_id AS lecture, 'conv-' || conv_id || '#' || lpad(turn::VARCHAR, 4, '0') AS moment_id, conv_id, turn,
  turn * 20.0::DOUBLE AS t, [{_KINDS}][turn % 12 + 1] AS type, role AS system, text AS ad_text,
  lag(text) OVER w AS slide_ocr, NULL::VARCHAR AS what_on_screen, lead(text) OVER w AS transcript_window,
  ((conv_id * 7 + turn * 3) % 25) / 2.0::DOUBLE AS pause_after,
  CASE conv_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS renders_cursor
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a time line per user: t in whole seconds from the start of 2024."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("lecture"), "event_id", "event_type", F.floor(t).cast("double").alias("t"), "value", "props")


TIMELINE = "timeline AS (SELECT user_id AS lecture, event_id, event_type, floor(epoch_us(ts - TIMESTAMP '2024-01-01' + TIMESTAMP '1970-01-01') / 1e6)::DOUBLE AS t, value, props FROM events)"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as silences: they start then and last ``value`` tens of seconds."""
    return timeline(spark, sf_dir).where("event_type = 'error'").select("lecture", F.col("t").alias("start"), F.floor(F.col("t") + F.col("value") * 10).cast("double").alias("end"))


GAPS = "gaps AS (SELECT lecture, t AS start, floor(t + value * 10)::DOUBLE AS \"end\" FROM timeline WHERE event_type = 'error')"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).where("event_type = 'view'").select("lecture", "event_id", "t")


VIEWS = "views AS (SELECT lecture, event_id, t FROM timeline WHERE event_type = 'view')"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents of a source as pairs, with the scores of three scorers per side."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.length("text").alias("len"), F.size(F.split("text", " ")).alias("parts"))
    both = d.select("source", F.col("doc_id").alias("a_id"), F.lead("doc_id").over(w).alias("b_id"), F.col("lang").alias("axis"), F.col("n_chars").alias("a_chars"), F.lead("n_chars").over(w).alias("b_chars"), F.col("parts").alias("a_parts"), F.lead("parts").over(w).alias("b_parts"), F.row_number().over(w).alias("n"))
    side = F.when(F.col("a_id") % 5 == 0, F.lit("tie")).when(F.col("a_id") % 2 == 0, "a").otherwise("b")
    return both.where("n % 2 = 1 AND b_id IS NOT NULL").withColumn("pair_id", F.concat_ws("@", "a_id", "b_id")).withColumn("compliant_side", side)


PAIRS = """pairs AS (
SELECT *, a_id || '@' || b_id AS pair_id, CASE WHEN a_id % 5 = 0 THEN 'tie' WHEN a_id % 2 = 0 THEN 'a' ELSE 'b' END AS compliant_side
FROM (SELECT source, doc_id AS a_id, lead(doc_id) OVER w AS b_id, lang AS axis, n_chars AS a_chars, lead(n_chars) OVER w AS b_chars,
  len(string_split(text, ' ')) AS a_parts, lead(len(string_split(text, ' '))) OVER w AS b_parts, row_number() OVER w AS n
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
WHERE n % 2 = 1 AND b_id IS NOT NULL)"""


def side_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, axis, scorer, a, b): characters in thousands, words in hundreds, and the id's parity."""
    p = pairs(spark, sf_dir)
    score = lambda name, a, b: F.struct(F.lit(name).alias("scorer"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    three = F.array(score("chars", F.floor(F.col("a_chars") / 1000), F.floor(F.col("b_chars") / 1000)), score("words", F.floor(F.col("a_parts") / 100), F.floor(F.col("b_parts") / 100)), score("parity", F.col("a_id") % 3, F.col("b_id") % 3))
    return p.select("pair_id", "axis", "compliant_side", "a_id", F.explode(three).alias("s")).select("pair_id", "axis", "compliant_side", "a_id", "s.*")


SCORES = """scores AS (
SELECT pair_id, axis, compliant_side, a_id, 'chars' AS scorer, floor(a_chars / 1000) AS a, floor(b_chars / 1000) AS b FROM pairs
UNION ALL SELECT pair_id, axis, compliant_side, a_id, 'words', floor(a_parts / 100), floor(b_parts / 100) FROM pairs
UNION ALL SELECT pair_id, axis, compliant_side, a_id, 'parity', a_id % 3, b_id % 3 FROM pairs)"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rater, pair_id, axis, side): three raters made from the pair's ids."""
    side = lambda c: F.when(c == 0, F.lit("a")).when(c == 1, "b").when(c == 2, "tie").otherwise("a")
    p = pairs(spark, sf_dir)
    one = lambda name, c: F.struct(F.lit(name).alias("rater"), side(c).alias("side"))
    three = F.array(one("R1", F.col("a_id") % 4), one("R2", F.col("b_id") % 4), one("R3", (F.col("a_id") + F.col("b_id")) % 5))
    return p.select("pair_id", "axis", F.explode(three).alias("r")).select("r.rater", "pair_id", "axis", "r.side")


RATERS = """raters AS (
SELECT rater, pair_id, axis, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' ELSE 'a' END AS side FROM (
SELECT 'R1' AS rater, pair_id, axis, a_id % 4 AS k FROM pairs UNION ALL SELECT 'R2', pair_id, axis, b_id % 4 FROM pairs
UNION ALL SELECT 'R3', pair_id, axis, (a_id + b_id) % 5 FROM pairs))"""


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(moment_id, order, choice): a judge's answers in both orders, some missing."""
    o = table(spark, sf_dir, "orders")
    answer = lambda k: F.when(k == 0, F.lit("a")).when(k == 1, "b").when(k == 2, "tie")
    both = F.array(F.struct(F.lit(0).alias("order"), answer(F.col("o_orderkey") % 4).alias("choice")), F.struct(F.lit(1).alias("order"), answer(F.col("o_custkey") % 4).alias("choice")))
    return o.select(F.col("o_orderkey").alias("moment_id"), F.explode(both).alias("x")).select("moment_id", "x.*")


JUDGEMENTS = """judgements AS (
SELECT o_orderkey AS moment_id, 0 AS "order", CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' END AS choice FROM orders
UNION ALL SELECT o_orderkey, 1, CASE o_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' END FROM orders)"""
