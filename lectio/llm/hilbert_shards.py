"""Sharding along a Hilbert curve over metadata, by DataFrame and SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectio.llm.common import documents, texts, written

SHARDS = 8
BITS = 5
#: A cell of the grid is split into parts of max(PART_ROWS, rows / PARTS) rows, so that there are at
#: most PARTS parts more than cells, whatever share of all rows one cell holds.
PART_ROWS = 512
PARTS = 65_536


def hilbert_index(codes: list[str], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell with integer coordinates below 2**bits.

    Skilling, "Programming the Hilbert curve" (2004): undo the curve's turns from the highest bit
    down, Gray-encode, interleave the bits. One fold over the steps, so the plan stays small.
    """
    n, top = len(codes), 1 << (bits - 1)
    p = f"(shiftright({top}, cast(s div {n} as int)) - 1)"
    own, first = f"element_at(x, cast(s % {n} as int) + 1)", "element_at(x, 1)"
    turned = f"""aggregate(sequence(0, {n * (bits - 1) - 1}), array({", ".join(f"cast({c} as int)" for c in codes)}), (x, s) ->
        CASE WHEN {own} & ({p} + 1) != 0 THEN transform(x, (v, k) -> IF(k = 0, v ^ {p}, v))
        ELSE transform(x, (v, k) -> IF(k = 0 OR k = s % {n}, v ^ (({first} ^ {own}) & {p}), v)) END)"""
    if bits == 1:
        turned = f"array({', '.join(f'cast({c} as int)' for c in codes)})"
    gray = f"transform({turned}, (v, k) -> aggregate(slice({turned}, 1, k + 1), 0, (a, b) -> a ^ b))"
    flip = f"aggregate(sequence(1, {bits}), 0, (t, j) -> IF(element_at(g, {n}) & shiftleft(1, j - 1) != 0 AND j > 1, t ^ (shiftleft(1, j - 1) - 1), t))"
    joined = f"aggregate(sequence(0, {n * bits - 1}), 0L, (a, s) -> a * 2 + (shiftright(element_at(g, cast(s % {n} as int) + 1) ^ {flip}, {bits - 1} - cast(s div {n} as int)) & 1))"
    return F.expr(f"element_at(transform(array({gray}), g -> {joined}), 1)")


def document_codes(bits: int = BITS) -> dict[str, Column]:
    """Grid coordinates of a document: source and language (hashed), and size (two steps an octave)."""
    cells = 1 << bits
    hashed = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(cells)).cast("int")
    size = F.least(F.floor(2 * F.log2(F.col("size").cast("double"))), F.lit(cells - 1)).cast("int")
    return {"source_code": hashed("source"), "lang_code": hashed("lang"), "size_code": size}


def shard(rows: DataFrame, codes: dict[str, Column], tie: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``rows`` plus its codes, curve, shard and slot: runs of the curve whose lengths differ by one at most.

    Rows of one cell are ordered by part, then by ``tie``; equal ties may take each other's slots.
    Positions come from two prefix sums over small tables (cells: 2 ** (bits * codes) rows at most;
    parts: PARTS more), which are broadcast; no row is ranked with more rows than its part holds.
    """
    if bits * len(codes) > 18:
        raise ValueError("the grid of cells must stay small enough to broadcast")
    names = list(codes)
    coded = written(rows.withColumns(codes).withColumn("spread", F.xxhash64(*tie)), "shard-codes")
    cells = coded.groupBy(*names).agg(F.count("*").alias("n"))
    cells = written(cells.withColumn("curve", hilbert_index(names, bits)).withColumn("cell", F.col("curve")), "shard-cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    part_rows = max(PART_ROWS, -(-total // PARTS))
    split = cells.select(*names, "curve", F.ceil(F.col("n") / part_rows).alias("n_parts"))
    parted = coded.join(F.broadcast(split), names).withColumn("part", F.pmod("spread", "n_parts")).drop("n_parts", "spread")
    parts = parted.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(parts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")), "shard-parts")
    rank = F.row_number().over(Window.partitionBy("curve", "part").orderBy(*tie)) - 1
    placed = parted.withColumn("rank", rank).join(F.broadcast(starts), ["curve", "part"])
    position = F.col("part_start") + F.col("rank")
    short, longer = divmod(total, shards)
    border = longer * (short + 1)
    number = F.when(F.col("position") < border, F.expr(f"position div {short + 1}")).otherwise(F.lit(longer) + F.expr(f"(position - {border}) div {max(short, 1)}"))
    start = F.when(F.col("shard") < longer, F.col("shard") * (short + 1)).otherwise(border + (F.col("shard") - longer) * short)
    return placed.withColumn("position", position).withColumn("shard", number.cast("int")).withColumn("slot", (F.col("position") - start).cast("long")).drop("position", "rank", "part_start", "part")


def manifest(sharded: DataFrame, codes: list[str]) -> DataFrame:
    """One row per shard: rows, bytes, and each code's range, by which a reader skips files."""
    ranges = [f(c).alias(f"{name}_{c}") for c in codes for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *ranges)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and one), text_crc32, codes, curve, shard, slot.

    Null texts are empty, null sources and languages are one more value of their own (the empty one);
    rows that repeat a doc_id and a text are rows of their own. Other columns are ignored. The text is
    read once, to measure it; only numbers are shuffled.
    """
    meta = texts(docs, "source", "lang").select("doc_id", "source", "lang", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    return shard(meta, document_codes(), ["doc_id", "text_crc32", "size"], shards).drop("source", "lang")


def op7_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    sharded = shard_documents(documents(spark, sf_dir))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *document_codes())
