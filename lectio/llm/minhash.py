"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact Jaccard, distributed union-find.

Satuluri and Parthasarathy, "Bayesian Locality Sensitive Hashing for Fast Similarity Search" (2012).
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.blocks import first_of_part, joined_in_groups, joined_labels, spread_labels, stars_of, whole_groups
from lectio.llm.common import discard, documents, small_or_shuffled, texts, written

SHINGLE = 2
#: Two sets are linked if PARTS * intersection >= SIMILAR * union.
SIMILAR, PARTS = 80, 100
#: BANDS bands of ROWS minima: a pair of similarity 0.8 shares none with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Minima of a signature, one byte of each; the first BANDS * ROWS make the bands. They are compared a BATCH at a time.
HASHES, BATCH = 256, 32
#: After each batch a pair goes whose similarity is high enough with a probability below MISS, given what agreed.
MISS = 1e-5
#: Shingles whose minima are taken at once, so that they stay in a core's cache.
SPAN = 1 << 16

_seeds = random.Random(11)
FACTORS = [np.uint32(_seeds.getrandbits(32) | 1) for _ in range(HASHES)]
_ODD = [np.uint64(_seeds.getrandbits(64) | 1) for _ in range(4)]


# ---------------------------------------------------------------- sets and signatures


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return (h ^ (h >> np.uint64(29))) * _ODD[1]


def shingle_sets(values: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words of each text; of all words if there are fewer."""
    known: dict[bytes, int] = {}
    out = []
    for data in values:
        words = data.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(width, len(h))
        runs = np.full(max(0, len(h) - n + 1) if n else 0, n, np.uint64)
        for k in range(n):
            runs = _mixed(runs * _ODD[2] + h[k : k + len(runs)])
        out.append(np.unique(runs))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x HASHES) least products of an odd factor with the 32-bit hashes of a set, which each factor permutes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), HASHES), np.uint32)
    some = np.flatnonzero(sizes)
    stops = np.cumsum(sizes[some])
    first = 0
    while first < len(some):
        done = int(stops[first] - sizes[some[first]])
        last = max(first + 1, int(np.searchsorted(stops, done + SPAN)))
        part = (np.concatenate([sets[i] for i in some[first:last]]) >> np.uint64(32)).astype(np.uint32)
        starts = stops[first:last] - sizes[some[first:last]] - done
        for k, factor in enumerate(FACTORS):
            out[some[first:last], k] = np.minimum.reduceat(part * factor, starts)
        first = last
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(sets x BANDS) hashes of the bands, each with its band's number."""
    out = np.empty((len(minima), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(minima), b + 1, np.uint64) * _ODD[3]
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = _mixed(h * _ODD[2] + minima[:, k])
        out[:, b] = h
    return out.view(np.int64)


def _digests(sets: list[np.ndarray]) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]


def _signed_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), width)
            minima = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(_digests(sets), pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(list(band_keys(minima)), pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in minima.astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "node", "n_shingles", "bands", "signature"],
            )


# ---------------------------------------------------------------- posterior bounds


@functools.cache
def least_agreement(similarity: float = SIMILAR / PARTS, miss: float = MISS) -> tuple[int, ...]:
    """How many minima must agree after each batch for a pair to stay.

    With a flat prior, m of n that agree give a Beta(m + 1, n - m + 1) posterior, whose mass above
    ``similarity`` is the chance of at most m successes in n + 1 trials at that rate.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, 0
        while True:
            mass += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _survivors(signed: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that no batch prunes."""
    agreed = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_agreement()):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        agreed += np.count_nonzero(signed[i, cut] == signed[j, cut], axis=1)
        stays = agreed >= least
        i, j, agreed = i[stays], j[stays], agreed[stays]
    return i, j


# ---------------------------------------------------------------- what a block's pairs join


def candidate_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, node, part, asks, signature): a star for each part of a block that surviving pairs join.

    Pairs of a row that asks and any other row of its block are compared, unless they are in one part.
    """
    for table, starts in whole_groups(batches):
        signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(table), HASHES)
        asks = table.column("asks").to_numpy()
        labels = first_of_part(table, starts)
        sizes = np.diff(starts)
        small = np.repeat(sizes <= 16, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        found = [(np.empty(0, np.int64),) * 2]
        for gap in range(1, int(sizes[sizes <= 16].max(initial=1))):
            i = np.flatnonzero((group[gap:] == group[:-gap]) & small[gap:])
            i = i[(asks[i] | asks[i + gap]) & (labels[i] != labels[i + gap])]
            found.append(_survivors(signed, i, i + gap))
        for a, b in zip(starts[:-1][sizes > 16], starts[1:][sizes > 16], strict=True):
            own = labels[a:b].copy()
            for row in np.flatnonzero(asks[a:b]):
                others = np.flatnonzero(own != own[row]) + a
                pairs = _survivors(signed, np.full(len(others), a + row), others)
                found.append(pairs)
                own = joined_labels(own, row, pairs[1] - a)
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        yield stars_of(table, labels, spread_labels(labels, i, j))


def exact_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, block, node, part, asks, hashes): a star for each part of a block that links of whole sets join."""
    for table, starts in whole_groups(batches):
        raw = table.column("hashes").to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
        asks = table.column("asks").to_numpy()
        labels = first_of_part(table, starts)
        ends = np.cumsum(sizes)
        i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            values = np.frombuffer(b"".join(raw[a:b]), np.uint64)
            distinct, codes = np.unique(values, return_inverse=True)
            begin = ends[a:b] - sizes[a:b] - (ends[a] - sizes[a])
            own, size = labels[a:b].copy(), sizes[a:b]
            marked = np.zeros(len(distinct), np.int32)
            for row in np.flatnonzero(asks[a:b]):
                apart = own != own[row]
                if not apart.any():
                    continue
                mine = codes[begin[row] : begin[row] + size[row]]
                marked[mine] = 1
                common = np.add.reduceat(marked[codes], begin)
                marked[mine] = 0
                near = np.flatnonzero(apart & (PARTS * common >= SIMILAR * (size + size[row] - common)))
                if len(near):
                    i.append(np.full(len(near), a + row))
                    j.append(a + near)
                    own = joined_labels(own, row, near)
        yield stars_of(table, labels, spread_labels(labels, np.concatenate(i), np.concatenate(j)))


# ---------------------------------------------------------------- documents


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = shingle_sets(batch.column(0).slice(at, 512).cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array(_digests(sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"])


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are cut at ASCII white space of the text in lower case (A-Z); a document's set holds its
    distinct runs of ``width`` words, or all its words as one if it has fewer. Documents are linked if
    100 * intersection >= 80 * union of their sets; component_id is the smallest doc_id reachable, the
    document itself included, and kept says that it is the document's own.

    Equal sets are one node, so a group of copies costs one. Nodes that share a band are compared a
    batch of their signatures at a time, and pairs whose posterior chance of being similar falls below
    MISS go; what survives joins nodes to families, in which whole sets are compared. Null and blank
    texts have an empty set and are linked with nothing. A null doc_id never becomes a component's id
    unless it has no other. Rows that repeat a doc_id are rows of their own, each with its text's component; of rows
    that repeat a doc_id and are kept all are marked. Extra columns are ignored; an empty table gives an empty table.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, node binary, n_shingles long, bands array<long>, signature binary"
    signed = written(texts(docs).mapInArrow(lambda batches: _signed_batches(batches, width), schema), "minhash-signed")
    full = signed.where("node IS NOT NULL")
    classes = full.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = written(classes, "minhash-classes")
    banded = classes.select(F.explode("bands").alias("group"), "node")
    shared = written(banded.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "minhash-buckets")
    met = banded.join(small_or_shuffled(shared), "group")
    members = written(met.join(classes.select("node", "signature").hint("merge"), "node").select("group", "node", "signature"), "minhash-members")
    families = joined_in_groups(members.withColumn("part", F.col("node")), "signature", F.lit(0), candidate_stars, "minhash")
    discard(members)
    sought = families.join(classes.select("node", "first_id").hint("merge"), "node")
    sought = written(sought.select("node", "component", F.col("first_id").alias("rep")), "minhash-sought")
    ids = written(sought.select("rep").distinct(), "minhash-ids")
    near = texts(docs).join(small_or_shuffled(ids), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = near.mapInArrow(lambda batches: _set_batches(batches, width), "node binary, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    grouped = sets.join(sought.select("node", F.xxhash64("component").alias("group")).hint("merge"), "node").select("group", "node", "hashes")
    grouped = written(grouped, "minhash-sets")
    parts = joined_in_groups(grouped.withColumn("part", F.col("node")), "hashes", F.octet_length("hashes") / 8, exact_stars, "minhash-exact")
    discard(grouped)
    named = parts.join(classes.select("node", "first_id").hint("merge"), "node")
    least = written(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "minhash-least")
    linked = parts.join(small_or_shuffled(least), "component").select("node", "component_id")
    every = written(classes.select("node", "first_id").join(linked, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id")), "minhash-named")
    rows = signed.select("doc_id", "node", "n_shingles").join(every.hint("merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
