"""Rolling window features over events in time: an indexable skip list as a sliding multiset."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import documents, texts, written
from lectio.llm.resampling import CRC_SQL

WINDOWS = (1800, 86_400)
#: A source's time line is cut into segments of a window's length, of SEGMENT seconds at least.
SEGMENT = 21_600
LEVELS = 16


class SkipList:
    """A multiset of integers with ranks: sorted nodes, links on several levels, each with the number of items it spans.

    A value is one node, whose weight is how often it is in the set. Pugh, "A Skip List Cookbook" (1990).
    """

    def __init__(self, levels: int = LEVELS):
        self.levels = levels
        self.head = [None, 0, [None] * levels, [0] * levels]  # value, weight, next nodes, items up to and with the next node
        self.size = self.total = 0
        self.draw = random.Random(7).getrandbits

    def add(self, value: int, weight: int) -> None:
        """Put ``weight`` copies of a value in, or take them out if it is negative; a value of weight 0 loses its node."""
        path, at, node, passed = [None] * self.levels, [0] * self.levels, self.head, 0
        for level in range(self.levels - 1, -1, -1):
            after = node[2][level]
            while after is not None and after[0] < value:
                passed += node[3][level]
                node = after
                after = node[2][level]
            path[level], at[level] = node, passed
        found = node[2][0]
        self.size += weight
        self.total += weight * value
        if found is None or found[0] != value:
            height = 1
            while height < self.levels and self.draw(2) == 0:
                height += 1
            new = [value, weight, [None] * height, [0] * height]
            for level in range(height):
                before = path[level]
                new[2][level] = before[2][level]
                own = passed - at[level]
                new[3][level] = before[3][level] - own
                before[2][level], before[3][level] = new, own + weight
            for level in range(height, self.levels):
                path[level][3][level] += weight
            return
        found[1] += weight
        for level in range(self.levels):
            path[level][3][level] += weight
        if found[1] == 0:
            for level, after in enumerate(found[2]):
                before = path[level]
                before[2][level] = after
                before[3][level] += found[3][level]

    def number(self, rank: int) -> int:
        """The item of a rank, counted from 1 in ascending order."""
        node = self.head
        for level in range(self.levels - 1, -1, -1):
            after = node[2][level]
            while after is not None and node[3][level] < rank:
                rank -= node[3][level]
                node = after
                after = node[2][level]
        return node[2][0][0]


class Window:
    """What a window holds: rows, the multiset of their lengths, and how many rows have each language."""

    def __init__(self):
        self.rows = 0
        self.lengths = SkipList()
        self.langs: dict[str, int] = {}

    def add(self, length: int | None, lang: str | None, n: int) -> None:
        self.rows += n
        if length is not None:
            self.lengths.add(length, n)
        if lang is not None:
            left = self.langs.get(lang, 0) + n
            if left:
                self.langs[lang] = left
            else:
                del self.langs[lang]

    def features(self) -> tuple:
        m = self.lengths.size
        middle, high = (self.lengths.number(-(-m // 2)), self.lengths.number(-(-99 * m // 100))) if m else (None, None)
        return self.rows, self.lengths.total, len(self.langs), middle, high


ASK, ENTER, LEAVE = 0, 1, 2


def _rolled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (line, window_s, segment, at, what, event_s, length, lang, n) in that order: a row of features for each ASK."""
    key, window = None, Window()
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        rows = []
        for line, width, segment, at, what, length, lang, n in zip(*columns, strict=True):
            if key != (line, width, segment):
                key, window = (line, width, segment), Window()
            if what == ASK:
                rows.append((line, width, at, *window.features()))
            else:
                window.add(length, lang, n if what == ENTER else -n)
        out = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [batch.schema.field(0).type] + [pa.int64()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["line", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"])


def rolling(events: DataFrame, windows: tuple[int, ...] = WINDOWS, segment: int = SEGMENT) -> DataFrame:
    """Features of the windows before each moment at which a line has an event.

    ``events`` has line, event_s, length and lang. For each distinct (line, event_s) and window W one row:
    line, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars of the line's events with event_s - W <= time < event_s.
    A null line is one line; null lengths and languages count as rows only; without lengths the sum is
    0 and both order statistics are null.

    Equal events are summed before they are shuffled. A line's time is cut into segments, and an event goes to
    those whose moments can see it, so that neither a hot line nor a long history meets in one task.
    There it enters and leaves in the order of time, so a task holds the distinct lengths of one window.
    """
    spark = events.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = written(events.groupBy("line", "event_s", "length", "lang").agg(F.count("*").alias("n")), "rolling-groups")
    moments = groups.select("line", "event_s").distinct()
    width = F.explode(F.array(*[F.lit(w).cast("long") for w in windows])).alias("window_s")
    long = F.greatest(F.col("window_s"), F.lit(segment).cast("long"))
    part = lambda at: F.floor(at / long)
    asked = moments.select("line", "event_s", width).select("line", "window_s", part(F.col("event_s")).alias("segment"), F.col("event_s").alias("at"), F.lit(ASK).alias("what"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("n"))
    seen = groups.select("*", width).select("*", F.explode(F.sequence(part(F.col("event_s")), part(F.col("event_s") + F.col("window_s")))).alias("segment"))
    start = F.col("segment") * long
    enter = F.struct(F.greatest("event_s", start - 1).alias("at"), F.lit(ENTER).alias("what"))
    leave = F.struct((F.col("event_s") + F.col("window_s")).alias("at"), F.lit(LEAVE).alias("what"))
    steps = seen.select("*", F.explode(F.when(part(F.col("event_s") + F.col("window_s")) == F.col("segment"), F.array(enter, leave)).otherwise(F.array(enter))).alias("step"))
    moved = steps.select("line", "window_s", "segment", "step.at", "step.what", F.col("length").cast("long").alias("length"), "lang", "n")
    rows = asked.unionByName(moved).repartition(tasks, "line", "window_s", "segment").sortWithinPartitions("line", "window_s", "segment", "at", "what")
    kind = dict(events.dtypes)["line"]
    return rows.mapInArrow(_rolled_batches, f"line {kind}, window_s long, event_s long, n_events long, sum_chars long, n_langs long, median_chars long, high_chars long")


def event_time(doc_id: Column) -> Column:
    """60 * floor((doc_id + crc32(doc_id in decimal) mod 1000) / 6); a null doc_id is taken as 0."""
    number = F.coalesce(doc_id.cast("long"), F.lit(0).cast("long"))
    return (60 * F.floor((number + F.pmod(F.crc32(number.cast("string").cast("binary")), F.lit(1000))) / 6)).cast("long")


def window_features(docs: DataFrame, windows: tuple[int, ...] = WINDOWS, segment: int = SEGMENT) -> DataFrame:
    """One row per document and window: doc_id, window_s, event_s and the features of its source's window before it.

    The line is the source (null is one), the length that of the text in code points (null text: none; empty: 0), the
    languages those of all rows that aren't null. Rows at one moment don't see each other. Rows that repeat a doc_id have
    their own results. Extra columns are ignored; an empty table gives an empty table.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast(kind), "source", "lang", F.char_length("text").cast("long").alias("length"))
    rows = rows.withColumn("line", F.col("source").cast("string")).withColumn("event_s", event_time(F.col("doc_id")))
    rows = written(rows.select("doc_id", "line", "event_s", "length", F.col("lang").cast("string").alias("lang")), "rolling-rows")
    found = written(rolling(rows, windows, segment), "rolling-found").withColumnsRenamed({"line": "own", "event_s": "moment"})
    same = F.col("line").eqNullSafe(F.col("own")) & (F.col("event_s") == F.col("moment"))
    joined = rows.select("doc_id", "line", "event_s").join(found.hint("merge"), same)
    return joined.select("doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars")


def op13_rolling_features(spark, sf_dir: str) -> DataFrame:
    return window_features(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH h AS (SELECT *, lower(hex(encode(doc_id::VARCHAR))) AS h FROM documents),
e AS (SELECT doc_id, source, lang, length(text)::BIGINT AS n, (60 * ((doc_id + {CRC_SQL} % 1000) // 6))::BIGINT AS event_s FROM h),
w AS (SELECT e.*, window_s FROM e, (VALUES (1800::BIGINT), (86400::BIGINT)) v(window_s)),
p AS (SELECT a.doc_id, a.window_s, a.event_s, count(b.event_s) AS n_events, coalesce(sum(b.n), 0)::BIGINT AS sum_chars, count(DISTINCT b.lang) AS n_langs, list_sort(list(b.n) FILTER (b.n IS NOT NULL)) AS ns
  FROM w a LEFT JOIN e b ON a.source IS NOT DISTINCT FROM b.source AND b.event_s >= a.event_s - a.window_s AND b.event_s < a.event_s GROUP BY a.doc_id, a.window_s, a.event_s)
SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, ns[(len(ns) + 1) // 2] AS median_chars, ns[(99 * len(ns) + 99) // 100] AS high_chars FROM p
"""
