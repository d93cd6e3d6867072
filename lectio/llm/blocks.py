"""Links within groups of any size: blocks of rows compared in tasks, joined by stars and union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import small_or_shuffled, written
from lectio.llm.components import connected_components

#: A block of a group holds so many rows, or so much weight (hashes of shingles), at most.
BLOCK_ROWS, BLOCK_WEIGHT = 1024, 2_000_000
#: Rows of a large group that stand in each of its blocks, so that what resembles them is joined across blocks.
ANCHORS = 16


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (equal first two columns) of sorted rows, with the groups' first rows and the end."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        g, b = (table.column(k).to_numpy() for k in range(2))
        starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (b[1:] != b[:-1])])
        held = table.slice(int(starts[-1]))
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def spread_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least label of each row's component, if ``labels`` are numbers of rows and the pairs are links."""
    while True:
        new = labels.copy()
        np.minimum.at(new, i, labels[j])
        np.minimum.at(new, j, labels[i])
        np.minimum.at(new, labels, new)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def joined_labels(labels: np.ndarray, row: int, near: np.ndarray) -> np.ndarray:
    """The labels when a row's and those of the rows near it are one."""
    if not len(near):
        return labels
    return np.where(np.isin(labels, np.append(labels[near], labels[row])), labels[row], labels)


def first_of_part(table: pa.Table, starts: np.ndarray) -> np.ndarray:
    """For each row the first row of its group that is in the same part."""
    part = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    _, first, back = np.unique(group << 32 | part, return_index=True, return_inverse=True)
    return first[back]


def stars_of(table: pa.Table, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """Stars at the smallest node for what the rows' labels join, over all groups of a table that share a node."""
    moved = np.flatnonzero(before != after)
    node = table.column("node").combine_chunks()
    ends = pa.chunked_array([node.take(pa.array(moved)), node.take(pa.array(after[moved]))]).combine_chunks()
    names = ends.unique()
    names = names.take(pc.sort_indices(names))
    codes = pc.index_in(ends, names).to_numpy(zero_copy_only=False).astype(np.int64)
    root = spread_labels(np.arange(len(names)), codes[: len(moved)], codes[len(moved) :])
    points = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(points)), names.take(pa.array(root[points]))], ["u", "v"])


def joined_in_groups(members: DataFrame, payload: str, weight: Column, compare: Callable, label: str) -> DataFrame:
    """(node, component): the components that the links within all groups make; nodes without a link are absent.

    ``members`` is a written table of group (a long), node, part and ``payload``: rows of one part are known to belong together.
    ``compare`` gets sorted rows (group, block, node, part, asks, payload) and gives stars (u, v) for what it joins; ``weight``
    says how much of BLOCK_WEIGHT a row takes up. A group of one block has all its pairs
    compared in a task. A larger one is dealt into blocks, each with the group's ANCHORS too; after
    that only rows outside its largest part ask, each meeting every block of the group, so a family
    that holds together costs a linear number of rows, whatever its size.
    """
    spark = members.sparkSession
    kind = dict(members.dtypes)["node"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"u {kind}, v {kind}"
    spread = F.xxhash64("node")

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.select("group", "block", "node", "part", "asks", payload)
        dealt = rows.repartition(tasks, "group", "block").sortWithinPartitions("group", "block", "node")
        return written(dealt.mapInArrow(compare, schema), f"{label}-stars")

    sums = members.groupBy("group").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_WEIGHT), F.lit(1)).cast("long")
    sums = written(sums.select("group", blocks.alias("blocks")), f"{label}-sums")
    rows = members.join(small_or_shuffled(sums), "group").select("group", "blocks", "node", "part", payload, F.lit(True).alias("asks"))
    inside = rows.withColumn("block", F.pmod(spread, "blocks"))
    large = sums.where("blocks > 1")
    belongs = members.where("node != part").select(F.col("node").alias("u"), F.col("part").alias("v")).distinct()
    if large.isEmpty():
        return written(connected_components(compared(inside).union(belongs)), f"{label}-parts")
    held = written(rows.where("blocks > 1"), f"{label}-large")
    anchor = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks") * (BLOCK_ROWS // ANCHORS)) == 0
    copies = held.where(anchor).withColumn("own", F.pmod(spread, "blocks"))
    copies = copies.select(*rows.columns, F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != F.col("own"))).alias("block"))
    parts = written(connected_components(compared(inside.unionByName(copies)).union(belongs)), f"{label}-parts")
    named = held.drop("part", "asks").join(parts.withColumnsRenamed({"node": "of", "component": "part"}).hint("merge"), F.col("node") == F.col("of"), "left").drop("of")
    named = written(named.withColumn("part", F.coalesce("part", "node")), f"{label}-named")
    counted = named.groupBy("group", "part").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    all_of = counted.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("n").alias("most"))
    few = F.greatest(F.ceil((F.col("n") - F.col("most")) / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_WEIGHT * (1 - F.col("most") / F.col("n"))), F.lit(1)).cast("long")
    rest = written(all_of.where("most < n").select("group", "main", few.alias("askers")), f"{label}-rest")
    if rest.isEmpty():
        return parts
    again = named.join(small_or_shuffled(rest), "group")
    asker = F.col("part") != F.col("main")
    own, of = F.pmod(spread, "blocks"), F.pmod(F.xxhash64("node", F.lit(2)), "askers")
    asking = again.where(asker).withColumn("asks", F.lit(True)).select("*", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b * F.col("askers") + of)).alias("block"))
    asked = again.withColumn("asks", F.lit(False)).select("*", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1), lambda c: own * F.col("askers") + c)).alias("block"))
    known = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return written(connected_components(known.union(compared(asking.unionByName(asked)))), f"{label}-parts")
