"""Shared plumbing: the shared folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most a few dozen bytes; a side with more of them is shuffled instead of broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if re.fullmatch(r"local(\[.*\])?", context.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectio-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not the steps before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _open_scopes and not stays:
        _open_scopes[-1].append(out)
    return out


_open_scopes: list[list[DataFrame]] = []


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _handed_up(table: DataFrame) -> DataFrame:
    """Leave a table that the innermost scope wrote to the one around it, if there is one."""
    _open_scopes[-1] = [x for x in _open_scopes[-1] if x is not table]
    if len(_open_scopes) > 1:
        _open_scopes[-2].append(table)
    return table


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Discard at the end what was written inside, but the tables that the function it gives was called with."""
    _open_scopes.append([])
    try:
        yield _handed_up
    finally:
        discard(*_open_scopes.pop())


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as ``df`` needs to have no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if it has at most ``limit`` rows, else leave it to a shuffle.

    ``df`` must come from :func:`written`, so that counting it reads file footers only.
    """
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns, whatever else ``docs`` carries."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
