"""Ordered operators on groups of any size: range segments, a pass over each, boundary rows carried between them.

A window over a lecture sorts the whole lecture in one task. Here the rows of all groups are cut into segments of
about equal size along (group, order), so that one lecture with all rows takes as many tasks as many
lectures do. What a segment needs of those before and after it in the same group is a row of totals.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows sampled for each segment, to place its bounds.
SAMPLED = 40


@dataclass(frozen=True)
class Step:
    """What a row gets from its group: by kind, of a value."""

    kind: str
    value: Column | str | None = None


def number() -> Step:
    """The row's number in its group, from 1."""
    return Step("number")


def lag(value) -> Step:
    """The value of the row before; null in the first row."""
    return Step("lag", value)


def lead(value) -> Step:
    """The value of the row after; null in the last row."""
    return Step("lead", value)


def sum_before(value) -> Step:
    """The sum over all rows before; null in the first row."""
    return Step("sum_before", value)


def max_before(value) -> Step:
    """The greatest value of all rows before; null if there is none."""
    return Step("max_before", value)


def last(value) -> Step:
    """The last value that isn't null, up to this row."""
    return Step("last", value)


def following(value) -> Step:
    """The first value that isn't null, after this row."""
    return Step("following", value)


def bounds(rows: DataFrame, columns: list[str], parts: int) -> list[tuple]:
    """At most ``parts`` - 1 ascending bounds that cut the rows into parts of about equal size.

    They come from SAMPLED * parts rows with the least hashes, so that the same rows give the same bounds.
    """
    drawn = rows.select(*columns, F.xxhash64(*columns).alias("_h")).orderBy("_h").limit(SAMPLED * parts)
    ranked = [tuple(r)[:-1] for r in drawn.orderBy(*columns).collect()]
    return list(dict.fromkeys(ranked[len(ranked) * k // parts] for k in range(1, parts))) if len(ranked) >= parts else []


def segment_of(columns: list[str], schema: StructType, cuts: list[tuple]) -> Column:
    """How many of the bounds are at most the row's columns: a search in runs of bounds, then in one run."""
    width = max(1, int(len(cuts) ** 0.5))
    runs = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    names = [f.name for f in schema]
    record = lambda cut: dict(zip(names, cut, strict=True))
    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema)
    constant = lambda value, of: F.from_json(F.lit(json.dumps(value)), of)
    heads = constant([record(run[0]) for run in runs], f"array<struct<{kind}>>")
    nested = constant([[record(c) for c in run] for run in runs], f"array<array<struct<{kind}>>>")
    own = F.struct(*columns)
    at_most = lambda cut: cut <= own
    run = F.size(F.filter(heads, at_most))
    return F.when(run == 0, F.lit(0)).otherwise((run - 1) * width + F.size(F.filter(F.element_at(nested, run), at_most)))


def scan(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None, cuts: list[tuple] | None = None, **wanted: Step) -> DataFrame:
    """``rows`` with the ``wanted`` columns, each a step over the row's group in ascending order.

    ``order`` names columns of numbers or strings that tell the rows of a group apart as far as the result depends on it;
    a group that repeats one order very often isn't cut there. Null keys are a group, null orders come first.
    Bounds are sampled (40 rows a segment come to the driver) unless ``cuts`` gives those of a table of alike (keys, first
    orders), as :func:`bounds` finds them; carried totals are two rows a segment at most.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, *order]
    if cuts is None:
        cuts = bounds(rows, columns, parts)
    columns = columns[: len(cuts[0])] if cuts else columns
    schema = StructType([rows.schema[c] for c in columns])
    source = {name: step.value if isinstance(step.value, str) else f"_v_{name}" for name, step in wanted.items()}
    named = rows.withColumns({f"_v_{name}": step.value for name, step in wanted.items() if isinstance(step.value, Column)})
    placed = named.withColumn("_seg", segment_of(columns, schema, cuts) if cuts else F.lit(0))
    dealt = placed.repartitionById(max(1, len(cuts) + 1), "_seg")
    here = Window.partitionBy("_seg", *keys).orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    local = {
        "number": lambda v: F.row_number().over(here),
        "lag": lambda v: F.lag(v).over(here),
        "lead": lambda v: F.lead(v).over(here),
        "sum_before": lambda v: F.sum(v).over(before),
        "max_before": lambda v: F.max(v).over(before),
        "last": lambda v: F.last(v, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)),
        "following": lambda v: F.first(v, ignorenulls=True).over(here.rowsBetween(1, Window.unboundedFollowing)),
    }
    ends = {"_first": F.row_number().over(here) == 1, "_last": F.lead(F.lit(1)).over(here).isNull()} if cuts else {}
    out = dealt.withColumns({name: local[step.kind](source[name]) for name, step in wanted.items()} | ends)
    spare = [c for c in out.columns if c.startswith("_v_")]
    if not cuts:
        return out.drop("_seg", *spare)
    place = F.struct(*order)
    known = lambda v: F.when(F.col(v).isNotNull(), place)
    total = {
        "number": lambda v: F.count("*"),
        "lag": lambda v: F.max_by(F.struct(F.col(v).alias("v")), place),
        "lead": lambda v: F.min_by(F.struct(F.col(v).alias("v")), place),
        "sum_before": lambda v: F.sum(v),
        "max_before": lambda v: F.max(v),
        "last": lambda v: F.max_by(v, known(v)),
        "following": lambda v: F.min_by(v, known(v)),
    }
    group = Window.partitionBy(*keys).orderBy("_seg")
    earlier, later = group.rowsBetween(Window.unboundedPreceding, -1), group.rowsBetween(1, Window.unboundedFollowing)
    carry = {
        "number": lambda v: F.coalesce(F.sum(v).over(earlier), F.lit(0)),
        "lag": lambda v: F.lag(v).over(group)["v"],
        "lead": lambda v: F.lead(v).over(group)["v"],
        "sum_before": lambda v: F.sum(v).over(earlier),
        "max_before": lambda v: F.max(v).over(earlier),
        "last": lambda v: F.last(v, ignorenulls=True).over(earlier),
        "following": lambda v: F.first(v, ignorenulls=True).over(later),
    }
    cut_keys = list(dict.fromkeys(c[: len(keys)] for c in cuts))
    cut_groups = spark.createDataFrame(cut_keys, StructType([rows.schema[k] for k in keys])).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = lambda prefix: [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)]
    sums = placed.join(F.broadcast(cut_groups), same("_k"), "left_semi").groupBy("_seg", *keys).agg(*(total[step.kind](source[name]).alias(f"_t_{name}") for name, step in wanted.items()))
    carried = sums.select(F.col("_seg").alias("_s"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(carry[step.kind](f"_t_{name}").alias(f"_c_{name}") for name, step in wanted.items()))
    both = out.join(F.broadcast(carried), [F.col("_seg") == F.col("_s"), *same("_k")], "left")
    joined = {
        "number": lambda own, c: own + F.coalesce(c, F.lit(0)).cast("int"),
        "lag": lambda own, c: F.when(F.col("_first"), c).otherwise(own),
        "lead": lambda own, c: F.when(F.col("_last"), c).otherwise(own),
        "sum_before": lambda own, c: F.when(own.isNull(), c).when(c.isNull(), own).otherwise(own + c),
        "max_before": lambda own, c: F.greatest(own, c),
        "last": lambda own, c: F.coalesce(own, c),
        "following": lambda own, c: F.coalesce(own, c),
    }
    done = both.withColumns({name: joined[step.kind](F.col(name), F.col(f"_c_{name}")) for name, step in wanted.items()})
    return done.select(*rows.columns, *(n for n in wanted if n not in rows.columns))
