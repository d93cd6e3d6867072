"""Exact duplicate removal: counting quotient filters, merged, then a comparison of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import small_or_shuffled, texts, written
from lectio.llm.quotient import CountingQuotientFilter

Q_BITS = 32
#: A merge task gets one range of quotients with about so many fingerprints (16 bytes each).
RANGE_ROWS = 1 << 20


def range_bits(rows: int) -> int:
    """High bits of a fingerprint that tell its range: as many ranges as give RANGE_ROWS each, four at least."""
    return min(24, max(2, (max(0, rows - 1) // RANGE_ROWS).bit_length()))


def _filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """One filter per range of quotients from the fingerprints of a partition.

    A batch's filter is merged with the last one as soon as that isn't more than twice as large, so that a
    slot is moved a logarithmic number of times; memory holds the partition's distinct fingerprints.
    """
    stack: list[CountingQuotientFilter] = []
    for batch in batches:
        stack.append(CountingQuotientFilter.build(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), q_bits=Q_BITS))
        while len(stack) > 1 and len(stack[-2].remainders) <= 2 * len(stack[-1].remainders):
            last = stack.pop()
            stack[-1] = stack[-1].merge([last])
    held = stack[0].merge(stack[:0:-1]) if stack else None
    if held is None or not len(held.remainders):
        return
    prints = held.fingerprints()
    ranges = (prints >> np.uint64(64 - bits)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
    ends = np.r_[cuts[1:], len(prints)]
    parts = [CountingQuotientFilter.build(prints[a:b], held.counts[a:b], Q_BITS).to_bytes() for a, b in zip(cuts, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts], pa.int32()), pa.array(parts, pa.binary())], ["quotient_range", "filter"])


def _merged(table: pa.Table) -> pa.Table:
    """Merge the filters of one range; return the fingerprints counted more than once."""
    filters = [CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()]
    whole = filters[0].merge(filters[1:])
    often = whole.counts > 1
    return pa.table({"fingerprint": whole.fingerprints()[often].view(np.int64), "n": whole.counts[often].astype(np.int64)})


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fingerprint, n) of every fingerprint that occurs more than once in a one-column frame.

    A hot fingerprint is one slot with a count in each partition's filter, whatever its share. The
    number of ranges follows from the counted rows, so a merge task's memory doesn't grow with the input.
    """
    bits = range_bits(fingerprints.count())
    filters = fingerprints.mapInArrow(lambda batches: _filters(batches, bits), "quotient_range int, filter binary")
    return filters.groupBy("quotient_range").applyInArrow(_merged, "fingerprint long, n long")


def normalised(column: str = "text") -> F.Column:
    return F.regexp_replace(F.col(column), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, broadcast_rows: int = 4_000_000) -> DataFrame:
    """One row per document: its group of equal normalised texts and whether it stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal if they are the same
    after each run of ASCII white space became one space; a null text is empty. The smallest doc_id
    of a group stays; a null doc_id stays only where the group has no other. Of rows that repeat a
    doc_id and a text exactly one is kept. Other columns, of whatever name, are ignored.

    The fingerprints' filters say which texts may repeat; only those texts are shuffled (one row per
    partition and text, by partial aggregation) and compared as bytes. A table of repeated
    fingerprints of over ``broadcast_rows`` rows (8 bytes each) is joined by a shuffle instead.
    """
    with_text = texts(docs).select("doc_id", normalised().alias("body")).withColumn("fingerprint", F.xxhash64("body"))
    keys = written(with_text.select("doc_id", "fingerprint", F.sha2("body", 256).alias("text_sha256")), "exact-keys")
    repeated = written(repeated_fingerprints(keys.select("fingerprint")), "exact-repeated")
    often = small_or_shuffled(repeated.select("fingerprint"), broadcast_rows)
    verified = (
        with_text.join(often, "fingerprint", "left_semi")
        .groupBy("fingerprint", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fingerprint", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = written(verified, "exact-groups")
    rows = keys.groupBy("doc_id", "fingerprint", "text_sha256").agg(F.count("*").cast("int").alias("copies"))
    rows = rows.join(groups.hint("merge"), ["fingerprint", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from lectio.llm.common import documents

    return exact_groups(documents(spark, sf_dir))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""
