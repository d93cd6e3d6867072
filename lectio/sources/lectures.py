"""Lecture artefacts, manifest, field map and catalogue (SRC-09 to SRC-20, PRJ-01 to PRJ-03, V-02 to V-07)."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.functions import ids, times
from lectio.operators.integrity import ContractError, require_unique
from lectio.sources import files


def words(documents: DataFrame, lecture: str = "lecture") -> DataFrame:
    """SRC-14: words with a start, trimmed, from transcript documents (words: array of start, word)."""
    rows = documents.select(lecture, F.explode("words").alias("w")).where("w.start IS NOT NULL")
    return rows.select(lecture, F.col("w.start").cast("double").alias("start"), F.trim("w.word").alias("text"))


def gaps(documents: DataFrame, lecture: str = "lecture") -> DataFrame:
    """SRC-15: complete gaps."""
    rows = documents.select(lecture, F.explode("silences").alias("s")).where("s.start IS NOT NULL AND s.end IS NOT NULL")
    return rows.select(lecture, "s.start", "s.end")


def slide_text(documents: DataFrame, lecture: str = "lecture") -> DataFrame:
    """SRC-16: frames with a readable time."""
    rows = documents.select(lecture, F.explode("frames").alias("f")).withColumn("time", times.clock_to_seconds(F.col("f.timestamp")))
    return rows.where(times.is_time("time")).select(lecture, "time", F.col("f.text").alias("text"))


def keyframes(paths: DataFrame, path: str = "path") -> DataFrame:
    """SRC-17: (path, time) of files named HHMMSS."""
    name = F.element_at(F.split(path, "/"), -1)
    return paths.withColumn("time", times.packed_to_seconds(name)).where("time IS NOT NULL")


def videos(paths: DataFrame, lecture: str, path: str = "path") -> DataFrame:
    """SRC-18: per lecture the first of mp4, mkv, webm, mov that there is."""
    rank = F.array_position(F.array(*map(F.lit, ("mp4", "mkv", "webm", "mov"))), F.lower(F.element_at(F.split(path, r"\."), -1)))
    return paths.withColumn("_r", rank).where("_r > 0").groupBy(lecture).agg(F.min_by(path, F.struct("_r", path)).alias("video"))


def flag(c) -> Column:
    """V-06: yes, no, or null for a blank; anything else fails the query."""
    text = F.lower(F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False).when(text == "", F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), text)).cast("boolean"))


def manifest(rows: DataFrame) -> DataFrame:
    """SRC-13: lectures once each, the split train or test, a tri-state pointer flag; empty is an error."""
    if rows.isEmpty():
        raise ContractError("the lecture manifest is empty")
    require_unique(rows, "lecture_id")
    split = F.when(F.col("split").isin("train", "test"), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("unknown split "), F.coalesce("split", F.lit("null")))))
    return rows.withColumn("split", split).withColumn("renders_cursor", flag("renders_cursor"))


def courses(lectures: DataFrame) -> DataFrame:
    """A-25: the lectures of each course, in order."""
    return lectures.groupBy("course").agg(F.array_sort(F.collect_list("lecture_id")).alias("lectures"))


#: Logical names and the columns they stand for unless mapped.
FIELDS = {"moment_id": "moment_id", "lecture": "lecture", "time": "time", "type": "type", "slide_text": "slide_ocr", "on_screen": "what_on_screen", "transcript_window": "transcript_window", "pause_after": "pause_after", "text": "ad_text", "emit": "emit"}


@dataclass(frozen=True)
class FieldMap:
    """PRJ-01 to PRJ-03: foreign column names for the logical ones."""

    columns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        unknown = sorted(set(self.columns) - set(FIELDS))
        if unknown:
            raise ContractError(f"no fields called {unknown}; known: {sorted(FIELDS)}")

    @classmethod
    def parse(cls, arguments: list[str]) -> FieldMap:
        """From ``name=column`` arguments."""
        pairs = [a.partition("=") for a in arguments]
        if any(not eq or not column for _, eq, column in pairs):
            raise ContractError("a field is mapped as name=column")
        return cls({name: column for name, _, column in pairs})

    def column(self, name: str) -> str:
        return self.columns.get(name, FIELDS[name])

    def canonical(self, rows: DataFrame) -> DataFrame:
        """The rows under the logical names, all unmapped columns kept."""
        have = set(rows.columns)
        of = lambda name, default=None: F.col(self.column(name)) if self.column(name) in have else F.lit(default)
        text = lambda name: F.coalesce(of(name).cast("string"), F.lit(""))
        number = lambda name: F.coalesce(of(name).try_cast("double"), F.lit(0.0))
        own = F.nullif(text("moment_id"), F.lit(""))
        parsed = ids.moment_of("output_id") if "output_id" in have else F.lit(None).cast("string")
        moment = F.coalesce(own, F.nullif(parsed, F.lit("")), F.raise_error(F.lit("a row names no moment")))
        made = {
            "moment_id": moment,
            "lecture": F.coalesce(F.nullif(text("lecture"), F.lit("")), ids.lecture_of(moment)),
            "t": number("time"),
            "time": number("time"),
            "type": text("type"),
            "slide_ocr": text("slide_text"),
            "what_on_screen": text("on_screen"),
            "transcript_window": text("transcript_window"),
            "pause_after": number("pause_after"),
        }
        for name, out in (("text", "ad_text"), ("emit", "emit")):
            if self.column(name) in have:
                made[out] = of(name)
        mapped = {self.column(n) for n in FIELDS}
        rest = [F.col(c) for c in rows.columns if c not in mapped and c not in made]
        return rows.select(*(v.alias(k) for k, v in made.items()), *rest)


class Catalogue:
    """SRC-09 to SRC-12: roles to files, under one root; each role once."""

    def __init__(self, root: str, roles: dict[str, str] | None = None):
        self.root, self.roles = root.rstrip("/"), {}
        for role, name in (roles or {}).items():
            self.register(role, name)

    def register(self, role: str, name: str) -> None:
        if role in self.roles:
            raise ContractError(f"role {role} is registered twice")
        if PurePosixPath(name).is_absolute() or ".." in PurePosixPath(name).parts:
            raise ContractError(f"{name} leads out of the dataset")
        self.roles[role] = name

    def path(self, role: str, **values: str) -> str:
        if role not in self.roles:
            raise ContractError(f"no role {role}; known: {sorted(self.roles)}")
        return f"{self.root}/{self.roles[role].format(**values)}"

    def read(self, spark: SparkSession, role: str, schema: str | None = None, **values: str) -> DataFrame:
        path = self.path(role, **values)
        kind = path.rsplit(".", 1)[-1]
        if kind == "parquet":
            return spark.read.parquet(path)
        if kind == "csv":
            return files.read_csv(spark, path)
        return (files.read_json if kind == "json" else files.read_jsonl)(spark, path, schema)
