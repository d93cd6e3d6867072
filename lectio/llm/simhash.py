"""SimHash near-duplicates: word shingles, pigeonhole blocks, Hamming check, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectio.llm.common import documents, small_or_shuffled, texts, unused, written
from lectio.llm.components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Blocks a bit string is split into; DISTANCE differing bits leave BLOCKS - DISTANCE of them equal.
BLOCKS = 5
#: A bucket of more fingerprints is split again by blocks of the bits that it doesn't fix.
BUCKET = 1024
LANES = np.uint64(0x0101010101010101)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(data: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``width`` words of UTF-8 text; of all words if there are fewer; none of none."""
    words = data.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[: -width]].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint per group of consecutive hashes: a bit is set if it is in over half of them.

    Bits are counted eight at a time in the byte lanes of a word, at most 255 hashes to a partial sum.
    """
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    starts = np.r_[0, np.cumsum(sizes)[:-1]][some]
    lengths = sizes[some]
    pieces = -(-lengths // 255)
    first = np.r_[0, np.cumsum(pieces)[:-1]]
    within = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + 255 * within
    for low in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(low)) & LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for lane in range(8):  # little-endian: lane k holds bit 8 k + low
            out[some] |= (counts[:, lane] * 2 > lengths).astype(np.uint64) << np.uint64(8 * lane + low)
    return out


def fingerprints_of(values: list[bytes | None]) -> np.ndarray:
    per_text = [shingle_hashes(x or b"") for x in values]
    sizes = np.fromiter(map(len, per_text), np.int64, len(per_text))
    flat = np.fromiter((h for hashes in per_text for h in hashes), np.uint64, int(sizes.sum()))
    return majority(flat, sizes)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # bounds the hashes held at once
            part = batch.slice(at, 256)
            prints = fingerprints_of(part.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of each row, from its whole text; null texts are empty."""
    kind = dict(docs.dtypes)["doc_id"]
    return texts(docs).mapInArrow(_fingerprint_batches, f"doc_id {kind}, fingerprint long")


# ---------------------------------------------------------------- links


def masks_within(free: int, blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Split the set bits of ``free`` into blocks; a mask for each choice of blocks that must agree."""
    bits = [b for b in range(64) if free >> b & 1]
    groups = [sum(1 << b for b in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(choice) for choice in combinations(groups, blocks - distance)]


def _links_in(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected part of one bucket's distinct fingerprints: (member, smallest member)."""
    n = len(prints)
    label = np.arange(n)
    step = max(1, (1 << 20) // n)
    near = [np.bitwise_count(prints[a : a + step, None] ^ prints[None, :]) <= DISTANCE for a in range(0, n, step)]
    while True:
        new = np.concatenate([np.where(x, label[None, :], n).min(axis=1) for x in near])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(n))
    return prints[linked], prints[label[linked]]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, fingerprint) sorted by bucket: links within each bucket, or a large bucket's rows again.

    Of a large bucket no more than BUCKET + 1 rows are held at a time; its rows are passed on (link
    null) to be dealt out anew. Small buckets are compared many at once, by distance in the sort order.
    """
    held_mask = held = np.empty(0, np.uint64)
    large: tuple[int, int] | None = None
    for batch in batches:
        mask = np.r_[held_mask, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]
        prints = np.r_[held, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        key = prints & mask
        starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        open_from = int(starts[-1])  # the last bucket may go on in the next batch
        last = (int(mask[open_from]), int(key[open_from]))
        yield from _settle(mask[:open_from], prints[:open_from], starts[:-1], large)
        held_mask, held = mask[open_from:], prints[open_from:]
        if large is not None and (large != last):
            large = None
        if len(held) > BUCKET or large == last:
            if 64 - last[0].bit_count() > 10:
                large = last
                yield _rows(held_mask, held, None)
                held_mask, held = held_mask[:0], held[:0]
    if len(held):
        yield from _settle(held_mask, held, np.array([0]), large)


def _rows(mask: np.ndarray, prints: np.ndarray, link: np.ndarray | None) -> pa.RecordBatch:
    links = pa.nulls(len(prints), pa.int64()) if link is None else pa.array(link.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(mask.view(np.int64)), pa.array(prints.view(np.int64)), links], ["mask", "fingerprint", "link"])


def _settle(mask: np.ndarray, prints: np.ndarray, starts: np.ndarray, large: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    if not len(prints):
        return
    sizes = np.diff(np.r_[starts, len(prints)])
    run = np.repeat(np.arange(len(starts)), sizes)
    goes_on = np.array([large == (int(mask[a]), int(prints[a] & mask[a])) for a in starts[:1]])  # only the first can
    small = sizes <= 16
    small[:1] &= ~goes_on
    for gap in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero((run[gap:] == run[:-gap]) & small[run[gap:]])
        i = i[np.bitwise_count(prints[i] ^ prints[i + gap]) <= DISTANCE]
        if len(i):
            yield _rows(mask[i], prints[i + gap], prints[i])
    for k in np.flatnonzero(~small):
        a, b = starts[k], starts[k] + sizes[k]
        if (b - a > BUCKET or (k == 0 and goes_on[0])) and 64 - int(mask[a]).bit_count() > 10:
            yield _rows(mask[a:b], prints[a:b], None)
        else:
            member, least = _links_in(prints[a:b])
            if len(member):
                yield _rows(np.full(len(member), mask[a]), member, least)


def _split_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once per finer mask: the bits fixed so far and, of the rest, a choice of blocks."""
    for batch in batches:
        mask = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for old in np.unique(mask):
            prints = batch.column(1).filter(pa.array(mask == old))
            for more in masks_within(~int(old) & (2**64 - 1)):
                finer = pa.array(np.full(len(prints), int(old) | more, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([finer, prints], ["mask", "fingerprint"])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links that connect whatever distinct fingerprints are at most DISTANCE bits apart.

    Pigeonhole: of BLOCKS blocks, DISTANCE differing bits leave two equal, so every close pair meets
    in one of ten buckets. A bucket gives a star for each of its connected parts, not its pairs. A
    bucket of over BUCKET fingerprints is dealt out again by blocks of its free bits; as every
    round fixes two fifths of them, at ten free bits it holds 1,024 fingerprints at most.
    """
    spark = distinct.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select(F.lit(0).cast("long").alias("mask"), "fingerprint")
    found = []
    while True:
        keyed = rows.mapInArrow(_split_masks, "mask long, fingerprint long")
        bucket = F.col("mask").bitwiseAND(F.col("fingerprint")).alias("bucket")
        dealt = keyed.repartition(partitions, "mask", bucket).sortWithinPartitions("mask", bucket, "fingerprint")
        done = written(dealt.mapInArrow(_bucket_links, "mask long, fingerprint long, link long"), "simhash-links")
        found.append(done.where("link is not null").select(F.col("fingerprint").alias("u"), F.col("link").alias("v")))
        rows = done.where("link is null").select("mask", "fingerprint")
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id of the documents reachable over links of at most three
    differing bits, the document itself included; n_links counts the other distinct fingerprints
    that its own was linked with in the buckets (0: none is near). Texts without words have
    fingerprint zero and link like any other. Equal fingerprints are one node, so a group of copies
    costs one. Null doc_ids never become a component's id unless it has no other; a repeated doc_id
    keeps its rows. Extra columns are ignored; an empty table gives an empty table.
    """
    prints = written(fingerprints(docs), "simhash")
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    edges = written(links(classes.select("fingerprint")).distinct(), "simhash-edges")
    parts = written(connected_components(edges), "simhash-parts")
    named = parts.join(classes.withColumnRenamed("fingerprint", "node"), "node").select("node", "component", "first_id")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = written(parts.join(least, "component").join(degree, "node").select(F.col("node").alias("fingerprint"), "component_id", "n_links"), "simhash-linked")
    every = classes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    every = written(every, "simhash-named")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return prints.join(every.hint("merge"), "fingerprint").select("doc_id", digits, "component_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component.

    Rows are told apart by doc_id and text; of a component the one with the smallest doc_id stays, one
    without a doc_id only if no other has one. Rows that repeat a doc_id and a text are copies: one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    near = written(near_duplicates(docs.select(key.alias("doc_id"), "text")), "simhash-near")
    counted = near.groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    own, other, n = unused(docs, "key", "other", "n")
    gone = written(counted.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(other)).distinct(), "simhash-gone")
    again = written(counted.where("n > 1").select(F.col("doc_id").alias(other)).distinct(), "simhash-again")
    same = F.col(own).eqNullSafe(F.col(other))
    kept = docs.withColumn(own, key).join(small_or_shuffled(gone), same, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    repeated = kept.join(small_or_shuffled(again), same, "left_semi")
    first = F.row_number().over(Window.partitionBy(own).orderBy(own))
    once = repeated.withColumn(n, first).where(F.col(n) == 1).select(*docs.columns)
    return kept.join(small_or_shuffled(again), same, "left_anti").select(*docs.columns).unionByName(once)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
