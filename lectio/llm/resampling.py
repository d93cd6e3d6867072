"""Importance resampling towards a target: hashed n-gram buckets by a dictionary of distinct features.

Xie et al., "Data Selection for Language Models via Importance Resampling" (2023).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectio.llm.common import documents, texts, written

#: Words are runs of digits, letters a to z and whatever isn't ASCII, after A-Z became a-z: a table for bytes.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LOW, HIGH = 1, 1
BUCKETS = 10_000
MIN_WORDS = 20
#: The share of the documents of MIN_WORDS words or more that is drawn: SHARE / OF.
SHARE, OF = 10, 100
SEED = 2024
#: Features whose gains are broadcast, the most frequent ones, so that no word is hot in the shuffle in which all others meet theirs.
OFTEN = 20_000



def features_of(data: bytes, low: int = LOW, high: int = HIGH) -> tuple[int, Counter[bytes]]:
    """Number of words, and how often each run of ``low`` to ``high`` words occurs, its words joined by one space."""
    words = data.translate(WORD_BYTES).split()
    counts: Counter[bytes] = Counter()
    for n in range(low, high + 1):
        counts.update(words if n == 1 else map(b" ".join, zip(*[words[k:] for k in range(n)], strict=False)))
    return len(words), counts


def _counted_batches(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            counted = [features_of(x, low, high) for x in part.column(1).cast(pa.binary()).to_pylist()]
            ends = [0]
            for _, c in counted:
                ends.append(ends[-1] + len(c))
            names = pa.array([x for _, c in counted for x in c], pa.binary()).cast(pa.string())
            numbers = pa.array([x for _, c in counted for x in c.values()], pa.int32())
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([names, numbers], ["feature", "n"]))
            columns = [pa.array(range(row, row + len(part)), pa.int64()), part.column(0), pa.array([n for n, _ in counted], pa.int64()), pa.array([c.total() for _, c in counted], pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "n_features", "features"])
            row += len(part)


def counted_features(docs: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(row, doc_id, n_words, n_features, features): each row's distinct features with their counts, and a number that is its own once this is written."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, n_words long, n_features long, features array<struct<feature:string,n:int>>"
    return texts(docs).mapInArrow(lambda batches: _counted_batches(batches, low, high), schema)


def dictionary(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, n, bucket): every distinct feature of all rows once, hashed once."""
    whole = counted.select(F.explode("features").alias("f")).groupBy("f.feature").agg(F.sum("f.n").alias("n"))
    return whole.select("feature", "n", F.pmod(F.crc32("feature"), F.lit(buckets)).cast("int").alias("bucket"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of each bucket of the source's dictionary: ``buckets`` rows at most.

    gain is floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))): the smoothed shares that
    the bucket has in the target, t of T, and in the source, s of S.
    """
    s = source.groupBy("bucket").agg(F.sum("n").alias("s"))
    t = target.groupBy("bucket").agg(F.sum("n").alias("t"))
    all_s, all_t = (float(df.agg(F.sum("n")).first()[0] or 0) for df in (source, target))
    up, down = F.coalesce("t", F.lit(0)).cast("double") + 1, F.col("s").cast("double") + 1
    ratio = up * (all_s + buckets) / (down * (all_t + buckets))
    return s.join(F.broadcast(t), "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weights(counted: DataFrame, words: DataFrame, gained: DataFrame, often: int) -> DataFrame:
    """(row, total): the summed gains of each row's features.

    The ``often`` most frequent features (by octaves of their counts) bring their gains by a broadcast; all others meet theirs in a
    shuffle of (feature, row, n), the only one in which a document's features are rows.
    """
    octave = F.floor(F.log2("n")).cast("int")
    sizes = sorted(words.groupBy(octave.alias("o")).count().collect(), reverse=True)
    least, held = 64, 0
    for o, size in sizes:
        held += size
        if held > often:
            break
        least = o
    priced = words.withColumn("o", octave).join(F.broadcast(gained), "bucket").select("feature", "gain", "o")
    rows = counted.select("row", F.explode("features").alias("f")).select("row", "f.feature", "f.n")
    met = rows.join(F.broadcast(priced.where(F.col("o") >= least).select("feature", "gain")), "feature", "left")
    rare = met.where("gain IS NULL").drop("gain").join(priced.where(F.col("o") < least).select("feature", "gain").hint("merge"), "feature")
    worth = F.sum(F.col("n") * F.col("gain")).alias("total")
    both = met.where("gain IS NOT NULL").groupBy("row").agg(worth).unionByName(rare.groupBy("row").agg(worth))
    return both.groupBy("row").agg(F.sum("total").alias("total"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a standard Gumbel draw) that a seed and the document's id decide (null: an empty id)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: int = SEED, often: int = OFTEN) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of each row; ``row`` tells rows apart.

    A row stays one row until its features are counted, and the dictionary is summed where they are before it is shuffled.
    """
    counted = written(counted_features(docs, low, high), "resampling-counts")
    words = written(dictionary(counted, buckets), "resampling-words")
    wanted = written(dictionary(counted_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), low, high), buckets), "resampling-target")
    totals = _weights(counted, words, gains(words, wanted, buckets), often)
    known = counted.drop("features").join(totals, "row", "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return known.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).drop("total")


def resample(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, share: tuple[int, int] = (SHARE, OF), min_words: int = MIN_WORDS, seed: int = SEED, often: int = OFTEN) -> DataFrame:
    """One row per document: doc_id, n_features, n_words, weight, score, rank (null: not drawn).

    Of the documents of ``min_words`` words or more the highest scores are drawn, ``share`` of them, ties to
    the smaller doc_id (a null one first), then in any order. Weight is the mean gain of a document's features, rounded down,
    0 if it has none; score adds a Gumbel draw, which makes the highest scores a draw without
    replacement in proportion to the weights. A null text has no words. Rows that repeat a doc_id and a text each have their
    place. Extra columns are ignored; an empty table gives an empty table, an empty target gains by the source alone.

    Ranks come from the number of documents of each score, of which there are some tens of thousands
    whatever the input (gains and draws are bounded logarithms), and from an order within one score.
    """
    scored = written(weighted(docs, target, low, high, buckets, seed, often), "resampling-scores")
    fit = F.col("n_words") >= min_words
    quota = scored.where(fit).count() * share[0] // share[1]
    sizes = scored.where(fit).groupBy("score").agg(F.count("*").alias("m"))
    above = F.coalesce(F.sum("m").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = written(sizes.select(F.col("score").alias("s"), above.alias("above")).where(F.col("above") < quota), "resampling-drawn")
    joined = scored.join(F.broadcast(drawn), fit & (F.col("score") == F.col("s")), "left")
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "row"))
    placed = joined.where("above IS NOT NULL").withColumn("rank", F.when(place <= quota, place))
    rest = joined.where("above IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "n_words", "weight", "score", "rank")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    drawn = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC-32 of UTF-8 bytes in hex digits h, a bit at a time.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2), lambda k: (instr('0123456789abcdef', substr(h, 2 * k + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 2 * k + 2, 1)) - 1)),
  lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
e AS (SELECT doc_id, unnest(w) AS f FROM d),
x AS (SELECT f, lower(hex(encode(f))) AS h FROM (SELECT f FROM e UNION SELECT f FROM b)),
k AS (SELECT f, {CRC_SQL} % 10000 AS bucket FROM x),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM e JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN k USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM e) + 10000) / ((s + 1) * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM e JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
v AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN m USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM v),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM z WHERE n_features >= 20)
SELECT z.*, CASE WHEN place <= (SELECT count(*) FROM r) * 10 // 100 THEN place END AS "rank" FROM z LEFT JOIN r USING (doc_id)
"""
