"""Streaming forms of the ordered operators: a resume log, silences by session, what was described, novelty with state."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lectio.functions.text import SENTINELS, STOP_TERMS, TERM
from lectio.operators.sequence import DESCRIBED_WINDOW, ELEMENT_LENGTH, STRUCTURAL

# ---------------------------------------------------------------- the resume log


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs that the log has, from the names of its folders."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def logged_answers(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The rows of the log, of epochs below ``before`` if that is given."""
    there = [n for n in _epochs(spark, path) if before is None or n < before]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/epoch={n}" for n in there])


def append_answers(answers: DataFrame, path: str, checkpoint: str, key: str, after_write: Callable[[int], None] | None = None):
    """SRC-06, J-17 as a sink: every finished (error-free) answer of a key once, however often the query is killed and restarted.

    Each epoch has a folder of its own, which a repeated epoch overwrites as a whole, so that what was written
    and not committed isn't kept twice. A batch leaves out the keys that earlier epochs have finished, by
    an anti join with the log, and keeps one answer of a key that it finishes itself; failed answers of keys
    that no answer has finished stay as records. ``after_write`` is called with the epoch before it is committed.
    """
    schema = answers.schema
    fine = F.coalesce(F.col("error"), F.lit("")) == ""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = logged_answers(spark, path, schema, epoch).where(fine).select(key).distinct()
        open_rows = batch.join(done, key, "left_anti")
        whole = F.struct(*[F.col(c) for c in schema.names])
        finished = open_rows.where(fine).groupBy(key).agg(F.min(whole).alias("_r")).select("_r.*")
        failed = open_rows.where(~fine).join(finished.select(key), key, "left_anti").select(*schema.names)
        finished.select(*schema.names).unionByName(failed).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if after_write is not None:
            after_write(epoch)

    return answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- windows in time


def speech_stretches(events: DataFrame, key: str, at: str, silence: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """W-06 on a stream: stretches of speech that a silence ends, by session windows; late events wait for the watermark."""
    sessions = events.withWatermark(at, late).groupBy(key, F.session_window(at, silence)).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def event_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per kind and tumbling window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


# ---------------------------------------------------------------- described so far

_MARKERS = re.compile("|".join(re.escape(s) for s in sorted(SENTINELS, key=len, reverse=True)), re.IGNORECASE)


def _terms(text: str | None, cap: int) -> list[str]:
    """As :func:`lectio.functions.text.content_terms`, for one text."""
    seen: dict[str, str] = {}
    for term in re.findall(TERM, _MARKERS.sub(" ", text or "")):
        if len(seen) == cap:
            break
        if term.lower() not in STOP_TERMS:
            seen.setdefault(term.lower(), term)
    return list(seen.values())


class DescribedSoFar(StatefulProcessor):
    """W-09 with state: per lecture and writer the elements described, a map entry each, and the most recent ones as a list.

    Rows wait in a list until the watermark has passed their time; a timer then releases them in order of time and id, so
    that the stream gives the batch form's rows whatever the order in which they arrive.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = StructType([StructField("at", LongType()), StructField("id", StringType()), StructField("text", StringType()), StructField("slide", StringType())])
        self.waiting = handle.getListState("waiting", row)
        self.recent = handle.getListState("recent", StructType([StructField("term", StringType())]))
        self.seen = handle.getMapState("seen", StructType([StructField("term", StringType())]), StructType([StructField("n", IntegerType())]))
        self.count = handle.getValueState("count", StructType([StructField("n", IntegerType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, name, text, slide, emit in zip(frame["at"].astype("int64") // 1_000_000, frame["id"], frame["text"], frame["slide"], frame["emit"], strict=True):
                known = lambda x: None if x is None or x is pd.NA or x != x else str(x)
                self.waiting.appendValue((int(at), str(name), known(text) if emit is not None and emit == emit and bool(emit) else None, known(slide)))
                self.handle.registerTimer(int(at) + 1)
        yield pd.DataFrame(columns=["lecture", "writer", "id", "described", "new_elements", "elements_so_far"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in held if r[0] < until]
        if not ready:
            yield pd.DataFrame(columns=["lecture", "writer", "id", "described", "new_elements", "elements_so_far"])
            return
        self.waiting.put(held[len(ready) :]) if len(held) > len(ready) else self.waiting.clear()
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for _, name, text, slide in ready:
            shown = {t.lower() for t in _terms(slide, 80)} if slide else None
            new = []
            for term in _terms(text, DESCRIBED_WINDOW):
                low = term.lower()
                if len(low) < ELEMENT_LENGTH or low in STRUCTURAL or (shown is not None and low not in shown) or self.seen.containsKey((low,)):
                    continue
                n += 1
                self.seen.updateValue((low,), (n,))
                new.append(term)
            out.append((str(key[0]), str(key[1]), name, "; ".join(recent), ",".join(new), n))
            recent = [*recent, *new][-DESCRIBED_WINDOW:]
        if recent:
            self.recent.put([(t,) for t in recent])
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["lecture", "writer", "id", "described", "new_elements", "elements_so_far"])

    def close(self) -> None:
        pass


def described_stream(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """W-09, W-10 on a stream of (lecture, writer, at: timestamp, id, text, slide, emit): lecture, writer, id, described, new_elements, elements_so_far.

    Needs the RocksDB state store. Rows that come later than ``late`` are left out, as everywhere with a watermark.
    """
    schema = "lecture string, writer string, id string, described string, new_elements string, elements_so_far int"
    keyed = rows.select(F.col("lecture").cast("string").alias("lecture"), F.col("writer").cast("string").alias("writer"), "at", F.col("id").cast("string").alias("id"), "text", "slide", "emit")
    return keyed.withWatermark("at", late).groupBy("lecture", "writer").transformWithStateInPandas(DescribedSoFar(), outputStructType=schema, outputMode="append", timeMode="eventTime")


# ---------------------------------------------------------------- novelty


class Novelty(StatefulProcessor):
    """W-01 with state: the rows so far by number, with their size, and for each token the numbers of the rows that hold it.

    A row reads the entries of its own tokens only, the rarest first, and stops where no row that it
    hasn't met can beat the best overlap. Its own entries are the only ones that it writes.
    """

    def __init__(self, order: str, text: str):
        self.order, self.text = order, text

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = StructType([StructField("n", IntegerType())])
        self.count = handle.getValueState("count", number)
        self.rows = handle.getMapState("rows", number, StructType([StructField("tokens", StringType())]))
        self.often = handle.getMapState("often", StructType([StructField("token", StringType())]), number)
        self.postings = handle.getMapState("postings", StructType([StructField("token", StringType()), StructField("k", IntegerType())]), number)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for at, body in zip(frame[self.order], frame[self.text], strict=True):
            own = frozenset(re.findall("[a-z0-9]+", (body or "").lower()))
            often = {t: self.often.getValue((t,))[0] if self.often.containsKey((t,)) else 0 for t in own}
            best, met = 0.0, set()
            for k, token in enumerate(sorted(own, key=lambda t: (often[t], t))):
                if (len(own) - k) / len(own) <= best:  # a row not met yet holds none of the tokens before
                    break
                for i in range(often[token]):
                    row = self.postings.getValue((token, i))[0]
                    if row not in met:
                        met.add(row)
                        other = frozenset(self.rows.getValue((row,))[0].split())
                        both = len(own & other)
                        best = max(best, both / (len(own) + len(other) - both))
            out.append((str(key[0]), float(at), 1 - best))
            self.rows.updateValue((n,), (" ".join(sorted(own)),))
            for token in own:
                self.postings.updateValue((token, often[token]), (n,))
                self.often.updateValue((token,), (often[token] + 1,))
            n += 1
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["lecture", "at", "novelty"])

    def close(self) -> None:
        pass


def streaming_novelty(rows: DataFrame, lecture: str, order: str, text: str) -> DataFrame:
    """W-01 on a stream: (lecture, at, novelty) against all earlier rows of the lecture; rows of a batch go in order.

    Needs the RocksDB state store. State is an entry per row and one per row and token; none is rewritten.
    """
    keyed = rows.select(F.col(lecture).cast("string").alias(lecture), F.col(order).cast(DoubleType()).alias(order), text)
    return keyed.groupBy(lecture).transformWithStateInPandas(Novelty(order, text), outputStructType="lecture string, at double, novelty double", outputMode="append", timeMode="none")
