"""Readers and writers of row files (SRC-01 to SRC-08, SRC-12, SRC-21 to SRC-26)."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectio.operators.integrity import require_unique


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-01: one row per line; a line that doesn't parse fails the query. Give a schema in production."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_open(spark: SparkSession, path: str, schema: str, rest: str = "rest") -> DataFrame:
    """SRC-01, PRJ-01: lines of JSON as the columns of ``schema``, and ``rest``: a map of all other fields as VARIANT values, so that nothing is dropped.

    A field that doesn't fit its declared type is null there. A line that is no object fails the query; blank lines are left out.
    """
    declared = StructType.fromDDL(schema)
    lines = spark.read.text(path).where("trim(value) != ''")
    fields = F.from_json("value", "map<string, variant>", {"mode": "FAILFAST"})
    found = lines.select(fields.alias("_m"))
    typed = [F.try_variant_get(F.col("_m")[f.name], "$", f.dataType.simpleString()).alias(f.name) for f in declared]
    names = F.array(*[F.lit(f.name) for f in declared])
    return found.select(*typed, F.map_filter("_m", lambda k, v: ~F.array_contains(names, k)).alias(rest))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: header, all strings, quotes doubled, line breaks within quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-03: one document per file."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def load_yaml(spark: SparkSession, path: str) -> dict:
    """SRC-04: a mapping; an empty file is an empty one."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    found = yaml.safe_load(text)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found or {}


def guard_new(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """SRC-08: refuses a target that holds anything."""
    fs, p = _fs(spark, path)
    if not overwrite and fs.exists(p) and fs.getContentSummary(p).getLength() > 0:
        raise FileExistsError(f"{path} exists; name another target or allow overwriting")


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """SRC-05: the number of rows written, counted as they pass."""
    from pyspark.sql import Observation

    guard_new(df.sparkSession, path, overwrite)
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def append_jsonl(df: DataFrame, path: str) -> None:
    """SRC-06: the resume log."""
    df.write.mode("append").json(path)


def write_json(spark: SparkSession, value, path: str) -> None:
    """SRC-07: a small document, through the file system that Spark uses."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).encode()))
    out.close()


def answers(rows: DataFrame, value: str, system: str | None = None) -> DataFrame:
    """SRC-21: (moment_id, value) of finished answers; a moment answered twice is an error."""
    kept = rows.where(f"coalesce(error, '') = '' AND {value} IS NOT NULL")
    kept = kept.where(F.col("system") == system) if system else kept
    kept = kept.select("moment_id", F.col(value).alias("value"))
    require_unique(kept, "moment_id")
    return kept


def side_scores(rows: DataFrame, ordinal: str) -> DataFrame:
    """SRC-22: (pair_id, scorer, a, b); scorer or metric names it, the last row wins."""
    named = rows.withColumn("scorer", F.coalesce(*[F.col(c) for c in ("scorer", "metric") if c in rows.columns]))
    return named.groupBy("pair_id", "scorer").agg(F.max_by(F.struct("a", "b"), ordinal).alias("s")).select("pair_id", "scorer", "s.a", "s.b")


def rater_labels(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """SRC-23: one file per rater: (rater, pair_id, side)."""
    from lectio.operators.integrity import require_pseudonyms

    out = None
    for rater, path in sorted(files.items()):
        rows = read_jsonl(spark, path)
        side = F.coalesce(*[F.col(c) for c in ("side", "choice") if c in rows.columns], F.lit(""))
        one = rows.select(F.lit(rater).alias("rater"), "pair_id", side.alias("side"))
        out = one if out is None else out.unionByName(one)
    require_pseudonyms(out, "rater")
    return out


def cursor_facts(rows: DataFrame) -> DataFrame:
    """SRC-24: (lecture, pointing_allowed) of ``fact`` texts: a boolean, or an object with that field."""
    value = F.coalesce(F.col("fact").try_cast("boolean"), F.get_json_object("fact", "$.pointing_allowed").try_cast("boolean"))
    bad = F.raise_error(F.concat(F.lit("no cursor fact can be read for "), F.col("lecture")))
    return rows.select("lecture", F.when(value.isNull(), bad).otherwise(value).alias("pointing_allowed"))


def references_by_moment(rows: DataFrame, ordinal: str) -> DataFrame:
    """SRC-25: the texts of emitted, filled references, in order."""
    from lectio.functions.text import is_unfilled

    kept = rows.where(F.coalesce(F.col("emit"), F.lit(False)) & ~is_unfilled("ad_text"))
    return kept.groupBy("moment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, "ad_text"))), lambda x: x["ad_text"]).alias("references"))


def run_digest(settings: dict) -> str:
    """SRC-26, M-07: of the settings with their keys in order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def latest_checkpoint(names: DataFrame, column: str = "name") -> DataFrame:
    """SRC-26: the checkpoint with the highest number."""
    number = F.nullif(F.regexp_extract(column, r"^checkpoint-(\d+)$", 1), F.lit("")).try_cast("long")
    return names.withColumn("number", number).where("number IS NOT NULL").agg(F.max_by(column, "number").alias("latest"))
