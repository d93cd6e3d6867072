"""Fuzzy line deduplication by MinHash, in DataFrame functions.

``cut`` to ``close`` and ``line_stars`` are the same in numpy on Arrow batches: no query calls them, tests compare with them.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm import merges
from lectio.llm.blocks import first_of_part, joined_labels, spread_labels, stars_of, whole_groups
from lectio.llm.common import documents, scope, small_or_shuffled, texts, unused, written
from lectio.llm.components import connected_components

SIMILARITY = 0.8
#: A shingle is the SHINGLE characters from any position; a shorter line is one shingle.
SHINGLE = 8
#: Lines of fewer distinct shingles match exactly or not at all: one in four that differs is below SIMILARITY.
MIN_SHINGLES = 4
#: Bands, and minima in each: a pair of similarity s shares none with probability (1 - s**3)**8, 0.003 at 0.8.
BANDS, ROWS = 8, 3
#: A line goes by its shingles that begin with one of the first characters if these are FEWEST distinct ones or more and begin at
#: one position in SPARSE or more, else of the second, else by those of every position; one of fewer than FEWEST + MORE, or at
#: fewer than one in DENSER positions, goes by the next kind too.
SAMPLED, FEWEST, MORE, SPARSE, DENSER = ("aou27", "aeiou02579"), 24, 6, 16, 12
#: A sketch is the least hashes of a line's shingles. Its keys are three neighbours, from each place in a sketch of fewer than
#: DENSE hashes, one in two in one of fewer than twice as many, else one in four: a pair of similarity s shares none of the last
#: with a probability of about (1 - s**3 / 4)**42, 0.003 at 0.8. (That of the shingles that a line goes by varies about s.)
SKETCH, DENSE = 44, 16
#: White space but a newline, as ``str.split`` has it; characters among which all of it is, for a quick look.
WHITE = r"[\t\x0b-\x0d\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
UNEVEN = r"[\x00-\x09\x0b-\x1f\x80-\xa0\u1680-\u3000]"
#: The sets of lines of which each is in so many pairs go to all tasks, if they hold so many hashes (of 8 bytes) at most.
REPEATED, HELD = 4, 6_000_000
#: Lines of a family, about, whose shingles are counted, to tell which of them are rare there.
BLOCK_LINES = 512
#: In a bucket of at most so many lines all pairs are verified at once; in a larger one two stars come first, then rare shingles.
ALL_PAIRS = 16
#: Pairs that are verified at once: their number, and that of their lines, fits above the bits of a shingle's hash.
PAIRS, HASH_BITS = 512, np.uint64(54)
#: Windows whose minima are taken at once, so that they stay in a core's cache.
BLOCK = 1 << 17

_seeds = random.Random(20)
FACTORS = [np.uint32(_seeds.getrandbits(32) | 1) for _ in range(BANDS * ROWS)]
_seeds = random.Random(21)
_ODD = [np.uint64(_seeds.getrandbits(64) | 1) for _ in range(8)]


def normal_line(line: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(line.lower().split())


def shingle_set(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("r2")]


# ---------------------------------------------------------------- lines and signatures


def windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the SHINGLE characters from each position of each line, and their number per line.

    Positions are hashed all at once by doubling the width; those that reach into the next line go.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    if not counts.any():
        return np.empty(0, np.uint64), counts
    ends = np.cumsum(sizes)
    h = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    valid = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        valid[ends[ends >= k] - k] = False
    width = 1
    while width < SHINGLE:
        h = h[:-width] * _ODD[width.bit_length()] + h[width:]
        width *= 2
    h = h[valid[: len(h)]]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    h *= _ODD[5]
    return h, counts


def band_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines x bands) hashes of the bands, and which lines have them: those of MIN_SHINGLES positions or more.

    An odd factor permutes the 32-bit hashes of a line's shingles, and the least product is a MinHash.
    """
    hashes, counts = windows(lines)
    has = counts >= MIN_SHINGLES
    out = np.zeros((len(lines), BANDS), np.int64)
    chosen = np.flatnonzero(has)
    part_of = np.repeat(has, counts)
    short = (hashes[part_of] >> np.uint64(32)).astype(np.uint32)
    counts = counts[chosen]
    stops = np.cumsum(counts)
    first = 0
    while first < len(chosen):
        done = int(stops[first] - counts[first])
        last = max(first + 1, int(np.searchsorted(stops, done + BLOCK)))
        part = short[done : stops[last - 1]]
        starts = stops[first:last] - counts[first:last] - done
        for b in range(BANDS):
            h = np.full(last - first, b + 1, np.uint64) * _ODD[7]
            for factor in FACTORS[b * ROWS : (b + 1) * ROWS]:
                h = (h ^ np.minimum.reduceat(part * factor, starts).astype(np.uint64)) * _ODD[6]
                h ^= h >> np.uint64(29)
            out[chosen[first:last], b] = h.view(np.int64)
        first = last
    return out, has


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct line of a slice of texts: its key, text, bands and places."""
    for batch in batches:
        for low, high in merges.slices(pc.binary_length(batch.column(1)).to_pylist()):
            part = batch.slice(low, high - low)
            known: dict[str, int] = {}
            which, row, at = [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                for pos, raw in enumerate(text.split("\n")):
                    line = normal_line(raw)
                    if line:
                        which.append(known.setdefault(line, len(known)))
                        row.append(i)
                        at.append(pos)
            lines = list(known)
            which = np.array(which, np.int64)
            order = np.argsort(which, kind="stable")
            counts = np.bincount(which, minlength=len(lines))
            rows, pos = pa.array(np.array(row, np.int64)[order]), pa.array(np.array(at, np.int32)[order])
            fields = [part.column(0).take(rows), pos, part.column(2).take(rows), part.column(3).take(rows)]
            places = pa.StructArray.from_arrays(fields, ["doc_id", "pos", "r1", "r2"])
            keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode()) for x in lines]), "<i8").reshape(-1, 2)
            bands, has = band_hashes(lines)
            edges = np.append(0, np.cumsum(np.where(has, BANDS, 0)))
            banded = pa.ListArray.from_arrays(pa.array(edges[:-1].tolist() + [int(edges[-1])], pa.int32()), pa.array(bands[has].ravel()))
            held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array(lines, pa.string()), pa.array(counts.astype(np.int64)), banded, held],
                ["k1", "k2", "line", "n", "bands", "places"],
            )


def cut(docs: DataFrame) -> DataFrame:
    """(k1, k2, line, n, bands, places) of each distinct line that isn't blank, once per slice of texts.

    k1 and k2 are its 128-bit hash, bands is empty if the line is too short, places tells the row
    (doc_id, r1, r2) and position of each of its n occurrences there.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"k1 long, k2 long, line string, n long, bands array<long>, places array<struct<doc_id:{kind},pos:int,r1:long,r2:long>>"
    return texts(docs).select("doc_id", "text", *row_key()).mapInArrow(_cut_batches, schema)


def every(line: Column) -> Column:
    """Hashes of the SHINGLE characters from each position, repeats included: of 4 bytes a character, so that none has to be searched for."""
    starts = F.sequence(F.lit(1), 4 * (F.char_length(line) - SHINGLE) + 1, F.lit(4))
    hashes = lambda b: F.transform(starts, lambda at: F.xxhash64(F.substring(b, at, 4 * SHINGLE)))
    bound = F.get(F.transform(F.array(F.encode(line, "UTF-32")), hashes), F.lit(0))
    return F.when(F.char_length(line) >= SHINGLE, bound).otherwise(F.array().cast("array<long>"))


def beginning(line: Column, first: str) -> Column:
    """Hashes of the SHINGLE characters from each position of one of the characters ``first``, repeats included."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=([{first}].{{{SHINGLE - 1}}}))"), F.lit(1))
    return F.transform(found, lambda x: F.xxhash64(x))


def _keys(sketch: Column) -> Column:
    """Hashes of three neighbours in the sketch; of two as well where a line of five shingles may share no three with one of four."""
    n = F.size(sketch)
    at = lambda i: F.get(sketch, i)
    key = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))
    all_of = F.sequence(F.lit(0), n - 3)
    some = lambda skipped: F.filter(all_of, lambda i: at(i).bitwiseAND(skipped) == 0)
    three = F.transform(F.when(n < DENSE, all_of).when(n < 2 * DENSE, some(F.lit(1))).otherwise(some(F.lit(3))), key)
    two = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(at(i), at(i + 1)))
    return F.when(n < MIN_SHINGLES, F.array().cast("array<long>")).when(n > MIN_SHINGLES + 1, three).otherwise(F.concat(two, three))


def sketched(lines: DataFrame) -> DataFrame:
    """``lines`` with s0, s1, s2: the sketches by each kind of shingles, empty where another kind tells enough."""
    none = F.array().cast("array<long>")
    sketch = lambda c: F.slice(F.sort_array(c), 1, SKETCH)
    length, more = F.char_length("line"), F.lit(True)
    for kind, first in zip(("s0", "s1"), SAMPLED, strict=True):
        lines = lines.withColumn("more", more).withColumn("found", F.when(F.col("more"), beginning(F.col("line"), first)))
        lines = lines.withColumn("held", F.array_distinct("found"))
        n, at = F.size("held"), F.size("found")
        lines = lines.withColumn(kind, F.when((n >= FEWEST) & (SPARSE * at >= length), sketch(F.col("held"))).otherwise(none))
        more = F.col("more") & ((n < FEWEST + MORE) | (DENSER * at < length))
    return lines.withColumn("more", more).withColumn("s2", F.when(F.col("more"), sketch(F.array_distinct(every(F.col("line"))))).otherwise(none))


def _even(low: Column) -> Column:
    return F.when(low.contains("  ") | low.rlike(UNEVEN), F.regexp_replace(low, WHITE, " ")).otherwise(low)


def placed(docs: DataFrame) -> DataFrame:
    """(k1, k2, n, bands, places) of each line that isn't blank: a row for an occurrence, so n is 1. Other columns as of :func:`cut`."""
    low = texts(docs).select("doc_id", *row_key(), F.lower("text").alias("low"))
    even = low.withColumn("low", _even(F.col("low")))
    raw = even.select("doc_id", "r1", "r2", F.posexplode(F.split("low", "\n")).alias("pos", "raw"))
    lines = raw.select(F.trim("raw").alias("line"), F.array(F.struct("doc_id", "pos", "r1", "r2")).alias("places")).where("line != ''")
    keyed = sketched(lines).select("line", "places", F.array_distinct(F.concat(*(_keys(F.col(kind)) for kind in ("s0", "s1", "s2")))).alias("bands"))
    return keyed.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), F.lit(1).cast("long").alias("n"), "bands", "places")


def signatures(lines: DataFrame) -> DataFrame:
    """(k1, n, low, high): how often each key occurs, the range of its lines' k2."""
    return lines.groupBy("k1").agg(F.sum("n").alias("n"), F.min("k2").alias("low"), F.max("k2").alias("high"))


def told_apart(lines: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written lines and signatures with one k1 per line: where lines share one, all but one get another."""
    while not (shared := signed.where("low != high").select("k1", "low")).isEmpty():
        renamed = lines.join(small_or_shuffled(written(shared, "line-shared")), "k1", "left")
        moved = F.when(F.col("k2") != F.col("low"), F.xxhash64("k2", "k1")).otherwise(F.col("k1"))
        lines = written(renamed.withColumn("k1", moved).select(*lines.columns), "line-cut")
        signed = written(signatures(lines), "line-signatures")
    return lines, signed


# ---------------------------------------------------------------- similar lines


def _members(lines: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (k1, other) of the buckets of two or three lines, and (band, k1, m, low, top): the lines of each larger bucket.

    m is the bucket's size, low its smallest key and top its most frequent line. The third key of three is what the exclusive or
    of all leaves beside the smallest and the greatest. A line that occurs often is in a bucket once.
    """
    often = small_or_shuffled(written(signed.where("n > 1").select("k1", "n"), "line-often"))
    repeated = lines.select("k1", "bands").join(often, "k1").groupBy("k1").agg(F.first("bands").alias("bands"), F.first("n").alias("n"))
    repeated = written(repeated, "line-repeated")
    once = lines.select("k1", "bands").join(often, "k1", "left_anti").withColumn("n", F.lit(1).cast("long"))
    exploded = once.unionByName(repeated).select("k1", "n", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.bit_xor("k1").alias("odd"), F.count("*").alias("m")).where("low != high")
    buckets = written(buckets, "line-buckets")
    third = F.col("odd").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    few = [buckets.where("m <= 3").select(F.col("low").alias("k1"), F.col("high").alias("other"))]
    few += [buckets.where("m = 3").select(F.col(end).alias("k1"), third.alias("other")) for end in ("low", "high")]
    large = written(buckets.where("m > 3").select("band", "m", "low"), "line-large")
    members = written(exploded.join(small_or_shuffled(large), "band").select("band", "k1", "n", "m", "low"), "line-members")
    heads = members.where(f"m > {ALL_PAIRS}").groupBy("band").agg(F.max(F.struct("n", "k1")).alias("top"))
    heads = written(heads.select("band", F.col("top.k1").alias("top")), "line-heads")
    return few[0].union(few[1]).union(few[2]), members.join(small_or_shuffled(heads), "band", "left").select("band", "k1", "m", "low", "top")


def _ordered(pairs: DataFrame) -> DataFrame:
    both = pairs.where("k1 != other")
    return both.select(F.least("k1", "other").alias("a"), F.greatest("k1", "other").alias("b")).distinct()


def _candidates(few: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys a < b: ``few``, all of a bucket of at most ALL_PAIRS lines, two stars of a larger one."""
    stars = members.where(f"m > {ALL_PAIRS}").select("k1", F.explode(F.array("low", "top")).alias("other"))
    lists = members.where(f"m <= {ALL_PAIRS}").groupBy("band").agg(F.sort_array(F.collect_list("k1")).alias("ks"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(ks, (a, i) -> transform(slice(ks, i + 2, size(ks)), b -> struct(a AS k1, b AS other))))")).alias("p")).select("p.*")
    return _ordered(few.union(stars).union(pairs))


def _mixed(large: DataFrame, parts: DataFrame) -> DataFrame:
    """(group, node, part): the large buckets that hold lines of several components."""
    named = written(large.join(parts.withColumnRenamed("node", "k1").hint("merge"), "k1", "left").select("band", "k1", F.coalesce("component", "k1").alias("part")), "line-named")
    several = written(named.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("band"), "line-several")
    rows = named.join(small_or_shuffled(several), "band", "left_semi")
    return written(rows.select(F.col("band").alias("group"), F.col("k1").alias("node"), "part"), "line-mixed")


def _families(mixed: DataFrame) -> DataFrame:
    """(group, node, part): the lines of all buckets that have the same largest part, once; that part names the group."""
    counted = mixed.groupBy("group", "part").agg(F.count("*").alias("n"))
    main = written(counted.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main")), "line-main")
    return mixed.join(small_or_shuffled(main), "group").select(F.col("main").alias("group"), "node", "part").distinct()


def _common(lines: DataFrame) -> DataFrame:
    """(group, common): the shingles that two or more of about BLOCK_LINES lines of a group have, the most frequent last.

    They only say in which order shingles are looked at: any order gives the same pairs, that of their frequency the fewest tries.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = written(lines.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_LINES).alias("nth")), "line-families")
    some = lines.join(small_or_shuffled(sizes), "group").where(F.pmod(F.xxhash64("node", F.lit(2)), "nth") == 0)
    held = some.select("group", "line").repartition(tasks, "group").select("group", F.explode(F.array_distinct(every(F.col("line")))).alias("shingle"))
    counted = held.groupBy("group", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    ordered = counted.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    return written(ordered.select("group", F.col("common.shingle").alias("common")), "line-common")


def _apart(mixed: DataFrame, sought: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines of different parts, one of them outside the group's largest, that may be similar.

    Two sets of x and y shingles that share c or more, in whatever order, have one in common among the first x - c + 1 of the one
    and y - c + 1 of the other. Rare shingles come first here, and similar lines share 4 (x + y) / 9 or more: lines that share what
    all lines of their family have, and no rare shingle, never meet. No pair of a similarity of SIMILARITY or more is lost.
    """
    texts_of = sought.where(f"size >= {MIN_SHINGLES}").select(F.col("k1").alias("node"), "size", "line")
    lines = written(written(_families(mixed), "line-family").join(texts_of.hint("merge"), "node"), "line-sized")
    rows = lines.join(_common(lines).hint("merge"), "group", "left").select("group", "node", "part", "size", "common", F.array_distinct(every(F.col("line"))).alias("set"))
    rare, frequent = F.array_except("set", F.coalesce("common", F.array().cast("array<long>"))), F.array_intersect("common", "set")
    first = F.slice(F.concat(F.sort_array(rare), F.coalesce(frequent, F.array().cast("array<long>"))), 1, F.col("size") - F.expr("(4 * size + 4) div 5").cast("int") + 1)
    rows = rows.select("group", "node", "part", "size", F.posexplode(first).alias("at", "shingle"))
    rows = written(rows.select(F.xxhash64("group", "shingle").alias("key"), F.col("node").alias("k1"), F.col("part").alias("p"), F.col("size").alias("s"), "at", (F.col("part") != F.col("group")).alias("asks")), "line-rare")
    several = written(rows.groupBy("key").agg(F.min("p").alias("low"), F.max("p").alias("high")).where("low != high").select("key"), "line-several")
    rows = written(rows.join(small_or_shuffled(several), "key", "left_semi"), "line-rare")
    asking = rows.where("asks").select("key", F.col("k1").alias("other"), F.col("p").alias("q"), F.col("s").alias("z"), F.col("at").alias("to"))
    share = "(4 * (s + z) + 8) div 9"
    near = f"p != q AND (NOT asks OR k1 < other) AND at <= s - {share} AND to <= z - {share}"
    return _ordered(rows.hint("merge").join(asking, "key").where(near))


def line_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, node, part, asks, line): a star for each part of a block that links of whole sets join."""
    for table, starts in whole_groups(batches):
        hashes, counts = windows(table.column("line").to_pylist())
        ends = np.cumsum(counts)
        asks = table.column("asks").to_numpy()
        labels = first_of_part(table, starts)
        i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = labels[a:b].copy()
            row_of = np.repeat(np.arange(b - a), counts[a:b])
            values = hashes[ends[a] - counts[a] : ends[b - 1]]
            distinct, codes = np.unique(values, return_inverse=True)
            sets = np.unique(row_of.astype(np.int64) * len(distinct) + codes)
            row_of, codes = np.divmod(sets, max(1, len(distinct)))
            size = np.bincount(row_of, minlength=b - a)
            begin = np.cumsum(size) - size
            order = np.argsort(codes, kind="stable")
            holders, first = row_of[order], np.searchsorted(codes[order], np.arange(len(distinct) + 1))
            for row in np.flatnonzero(asks[a:b] & (size >= MIN_SHINGLES)):
                if (own == own[row]).all():
                    continue
                mine = codes[begin[row] : begin[row] + size[row]]
                common = np.bincount(np.concatenate([holders[first[c] : first[c + 1]] for c in mine.tolist()]), minlength=b - a)
                near = np.flatnonzero((own != own[row]) & (size >= MIN_SHINGLES) & (common >= SIMILARITY * (size + size[row] - common)))
                if len(near):
                    i.append(np.full(len(near), a + row))
                    j.append(a + near)
                    own = joined_labels(own, row, near)
        yield stars_of(table, labels, spread_labels(labels, np.concatenate(i), np.concatenate(j)))


def _sought(docs: DataFrame, lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(k1, line, size): the text of each line of the written ``keys``, cut again at one of its places, and its number of distinct shingles."""
    one = lines.join(small_or_shuffled(keys), "k1", "left_semi").groupBy("k1").agg(F.min(F.get("places", F.lit(0))).alias("place"))
    rows = written(one.groupBy("place.r1", "place.r2").agg(F.collect_list(F.struct("k1", "place.pos")).alias("held")), "line-held")
    found = texts(docs).select(*row_key(), "text").join(small_or_shuffled(rows), ["r1", "r2"]).select(F.split("text", "\n").alias("raw"), "held")
    found = found.select(F.explode(F.transform("held", lambda x: F.struct(x.k1.alias("k1"), F.get("raw", x.pos).alias("raw")))).alias("x"))
    found = found.select("x.k1", F.trim(_even(F.lower("x.raw"))).alias("line")).groupBy("k1").agg(F.first("line").alias("line"))
    return written(found.withColumn("size", F.size(F.array_distinct(every(F.col("line"))))), "line-sought")


def close(lines: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of numbers of lines has a similarity of SIMILARITY or more (of PAIRS pairs at most).

    The sets of all lines are one sorted run of (line, hash of shingle); what the two lines of a pair
    share stands twice in the sorted run of (pair, hash).
    """
    hashes, counts = windows(lines)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), counts)
    low = np.uint64(64) - HASH_BITS
    sets = np.sort(owner << HASH_BITS | hashes >> low)
    sets = sets[np.append(True, sets[1:] != sets[:-1])] if len(sets) else sets
    sizes = np.bincount((sets >> HASH_BITS).astype(np.int64), minlength=len(lines))
    starts = np.cumsum(sizes) - sizes
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    out = (small >= MIN_SHINGLES) & (small >= SIMILARITY * large)
    tried = np.flatnonzero(out)
    both = np.concatenate([a[tried], b[tried]])
    pair = np.tile(np.arange(len(tried), dtype=np.uint64), 2)
    n = sizes[both]
    at = np.repeat(starts[both] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    held = np.sort(np.repeat(pair, n) << HASH_BITS | (sets[at] << low) >> low)
    twice = held[1:][held[1:] == held[:-1]]
    common = np.bincount((twice >> HASH_BITS).astype(np.int64), minlength=len(tried))
    out[tried] = common >= SIMILARITY * (sizes[a[tried]] + sizes[b[tried]] - common)
    return out


def _similar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, PAIRS):
            u, v, la, lb = (batch.column(k).slice(low, PAIRS) for k in range(4))
            known = pa.chunked_array([la, lb]).combine_chunks().dictionary_encode()
            codes = known.indices.to_numpy()
            keep = pa.array(close(known.dictionary.to_pylist(), codes[: len(la)], codes[len(la) :]))
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])


def _fit(sought: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), with the sizes x and y of their sets, whose sizes don't rule out that they are similar."""
    sizes = sought.select("k1", "size")
    fit = pairs.join(sizes.withColumnsRenamed({"k1": "a", "size": "x"}), "a").join(sizes.withColumnsRenamed({"k1": "b", "size": "y"}), "b")
    return written(fit.where(f"least(x, y) >= {MIN_SHINGLES} AND 5 * least(x, y) >= 4 * greatest(x, y)").select("a", "b", "x", "y"), "line-fit")


def _verified(sought: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v): the pairs whose shingle sets have a Jaccard similarity of SIMILARITY or more.

    Of sets of x and y that share c it is c / (x + y - c), so 0.8 means 9 c = 4 (x + y). Where there are many pairs of few lines, as of one large
    bucket, the lines' sets are made once and go to all tasks; else each pair makes its two from the texts.
    """
    fit = _fit(sought, pairs)
    keys = written(fit.select(F.explode(F.array("a", "b")).alias("k1")).distinct(), "line-met")
    met, held = sought.join(small_or_shuffled(keys), "k1", "left_semi"), None
    if fit.count() > keys.count() * REPEATED:
        held = met.agg(F.sum("size")).first()[0]
    if held is not None and held <= HELD:
        sets = F.broadcast(written(met.select("k1", F.array_distinct(every(F.col("line"))).alias("set")), "line-sets"))
        both = fit.join(sets.withColumnsRenamed({"k1": "a", "set": "p"}), "a").join(sets.withColumnsRenamed({"k1": "b", "set": "q"}), "b")
        common = F.size(F.array_intersect("p", "q"))
    else:
        lines = sought.select("k1", "line")
        both = fit.join(lines.withColumnsRenamed({"k1": "a", "line": "la"}), "a").join(lines.withColumnsRenamed({"k1": "b", "line": "lb"}), "b")
        common = F.size(F.array_intersect(every(F.col("la")), every(F.col("lb"))))
    return both.where(9 * common >= 4 * (F.col("x") + F.col("y"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _similar_parts(docs: DataFrame, lines: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, component) of the lines that resemble another.

    All lines of a small bucket are compared. Of a large one two stars join most lines at a linear cost; where
    it still holds several components, its lines outside its largest one are compared with those that share a rare shingle.
    """
    with scope() as keep:
        few, members = _members(lines, signed)
        pairs = keep(written(_candidates(few, members), "line-pairs"))
        large = keep(written(members.where(f"m > {ALL_PAIRS}").select("band", "k1"), "line-crowded"))
    keys = pairs.select(F.explode(F.array("a", "b")).alias("k1")).union(large.select("k1")).distinct()
    sought = _sought(docs, lines, written(keys, "line-keys"))
    edges = written(_verified(sought, pairs), "line-similar")
    parts = written(connected_components(edges), "line-parts")
    mixed = _mixed(large, parts)
    if mixed.isEmpty():
        return parts
    more = _verified(sought, written(_apart(mixed, sought), "line-apart"))
    known = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return written(connected_components(written(known.union(more), "line-joined")), "line-parts")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(r1, r2, drop): for each row that loses lines, their positions.

    Of each component of equal or similar lines the occurrence with the smallest (doc_id, pos) stays.
    """
    lines = written(placed(docs), "line-cut")
    lines, signed = told_apart(lines, written(signatures(lines), "line-signatures"))
    often = signed.where("n > 1").select(F.col("k1").alias("k"))
    parts = _similar_parts(docs, lines, signed)
    alone = often.join(parts, often.k == parts.node, "left_anti").select(F.col("k").alias("k1"), F.col("k").alias("g"))
    flagged = written(parts.select(F.col("node").alias("k1"), F.col("component").alias("g")).union(alone).distinct(), "line-flagged")
    places = written(lines.select("k1", "places").join(small_or_shuffled(flagged), "k1").select("g", "places", F.array_min("places").alias("least")), "line-places")
    first = written(places.groupBy("g").agg(F.min("least").alias("first")), "line-first")
    drops = places.join(first.hint("merge"), "g").select("first", F.explode("places").alias("place")).where("place != first")
    return drops.groupBy("place.r1", "place.r2").agg(F.collect_set("place.pos").alias("drop"))


def dedup_lines(docs: DataFrame, broadcast_rows: int = 200_000, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with fuzzy duplicate lines taken out of text, and ``counts``: columns with the number of lines and of those dropped.

    Lines (cut at newlines) are compared in lower case with white space squeezed; blank lines stay.
    Similar lines are found by MinHash bands over the character shingles of every position and verified
    by the Jaccard similarity of the sets of shingles; of each component the line in the smallest doc_id
    (then the smallest position) stays.
    A null doc_id counts as smallest. Rows that repeat a doc_id and a text are treated alike. A null
    text stays null. All other columns pass through; n_chars, if there, is the new text's length.
    Columns that are called as ``counts`` are replaced.

    The drop lists go to all tasks if at most ``broadcast_rows`` documents have one, else by a join.
    """
    with scope() as keep:
        drops = keep(written(dropped_lines(docs), "line-drops"))
    r1, r2, drop = unused(docs, "r1", "r2", "drop")
    keyed = docs.select("*", *(c.alias(name) for c, name in zip(row_key(), (r1, r2), strict=True)))
    joined = keyed.join(small_or_shuffled(drops.withColumnsRenamed({"r1": r1, "r2": r2, "drop": drop}), broadcast_rows), [r1, r2], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(drop, i)), "\n")
    out = joined.withColumn(counts[0], F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")).withColumn(counts[1], F.coalesce(F.size(drop), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[c for c in docs.columns if c not in counts], *counts)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")
