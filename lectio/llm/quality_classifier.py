"""Quality by hierarchical empirical Bayes: a document classifier combined with site posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import documents, small_or_shuffled, texts, unused, written

#: Labelled rows that the classifier is fitted on at most, by order of a hash of doc_id: a bound.
SAMPLE_ROWS = 6_000
RIDGE = 1.0
THRESHOLD = 0.5
#: A document's evidence is bounded so that no single one settles its site.
MAX_LOGIT = 6.0
#: Prior strength, in documents, where the sites' spread tells nothing.
WEAKEST, STRONGEST = 1.0, 1e6

FEATURES = ("log_words", "word_length", "long_words", "symbols", "exclamations", "upper", "digits", "bars", "new_words", "echoes", "same_lines", "short_words", "ratio", "closed_symbols", "sentences", "empty")
_UPPER, _DIGIT = re.compile(r"[^\W\d_a-zß-ÿ]"), re.compile(r"\d")
_CLOSED = re.compile(r"[^\s\w.,;:]\s")


def features_of(text: str, compressor: zstandard.ZstdCompressor) -> list[float]:
    """FEATURES of a whole text: shares of its characters, words and lines; all 0 but ``empty`` without words."""
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n, size = len(words), len(text)
    lengths = [len(w) for w in words]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode()
    return [
        math.log(n),
        min(sum(lengths) / n, 30) / 5,
        sum(x > 18 for x in lengths) / n,
        sum(map(text.count, "#*$%&<>")) / n,
        min(text.count("!") / n, 2),
        len(_UPPER.findall(text)) / size,
        len(_DIGIT.findall(text)) / size,
        text.count("|") / n,
        len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines),
        sum(x <= 3 for x in lengths) / n,
        min(len(compressor.compress(data)) / len(data), 1.5),
        len(_CLOSED.findall(text)) / n,
        min(text.count(".") / n, 1),
        0.0,
    ]


class Classifier:
    """Ridge logistic regression on standardised features, by Newton steps; its logit is bounded."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE)
        penalty[-1] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-7:
                break
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.clip(z @ self.w[:-1] + self.w[-1], -MAX_LOGIT, MAX_LOGIT)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Classifier | None:
    """The classifier, fitted on SAMPLE_ROWS labelled rows at most; None unless both labels occur."""
    labelled = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("y"))
    chosen = labelled.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = texts(docs).join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = [features_of(t, compressor) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["doc_id", "x", "y"])

    measured = sample.select("text", "y", "doc_id").mapInArrow(measure, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>, y int")
    rows = measured.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).collect()  # one row per labelled id, however often it is repeated
    y = np.array([float(r.y > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    order = sorted(range(len(rows)), key=lambda i: (rows[i].y, rows[i].x))  # the same sums whatever the order of rows
    return Classifier(np.array([rows[i].x for i in order]), y[order])


def evidence(docs: DataFrame, classifier: Classifier | None, host: Column, path: Column, *keep: str) -> DataFrame:
    """doc_id, host, path, logit and the kept columns of each row: the classifier's logit of the whole text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), *keep)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            values = batch.column(1).to_pylist()
            logits = classifier.logit(np.array([features_of(t, compressor) for t in values])) if classifier and values else np.zeros(len(values))
            names = ["doc_id", "host", "path", *keep]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(logits)], [*names, "logit"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "host", "path", *keep))
    return rows.mapInArrow(run, f"{schema}, logit double")


def _strength(mean: Column, between: Column, noise: Column) -> Column:
    """Documents' worth of the prior: mean (1 - mean) / spread - 1, the spread less what noise explains."""
    spread = F.greatest(between - noise, F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(WEAKEST)), F.lit(STRONGEST))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Per (host, path): n, total, k (prior strength), host_n, host_total, k_host, m_host (the host's posterior); and the global mean.

    The host's mean is shrunk to the global one, the path's to its host's, each with a prior whose
    strength follows from how far the groups spread beyond chance (method of moments). Sums of groups
    are aggregations with a map-side part: a host with most documents is a few rows in the shuffle.
    """
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("total"), F.sum(p * p).alias("squares")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"), F.sum("squares").alias("host_squares")), "quality-hosts")
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_total").alias("t"), F.sum("host_squares").alias("q")).first()
    if not whole.n:
        nothing = F.lit(1.0)
        return paths.select("host", "path", "n", "total", nothing.alias("k"), F.col("n").alias("host_n"), F.col("total").alias("host_total"), nothing.alias("k_host"), F.lit(0.5).alias("m_host")), 0.5
    mean = min(max(whole.t / whole.n, 1e-3), 1 - 1e-3)

    def moments(groups: DataFrame, n: str, total: str, squares: str, centre: Column) -> tuple:
        """Mean square distance of group means from the centre, and what sampling explains of it, by documents."""
        own = F.col(total) / F.col(n)
        inside = F.greatest(F.col(squares) / F.col(n) - own * own, F.lit(0.0))
        row = groups.agg(F.sum(F.col(n) * (own - centre) * (own - centre)), F.sum(inside)).first()
        return row[0] / whole.n, row[1] / whole.n

    between, noise = moments(hosts, "host_n", "host_total", "host_squares", F.lit(mean))
    k_host = _strength(F.lit(mean), F.lit(between), F.lit(noise))
    shrunk = hosts.select("host", "host_n", "host_total", ((k_host * mean + F.col("host_total")) / (k_host + F.col("host_n"))).alias("m_host"))
    joined = written(paths.join(shrunk, "host"), "quality-sites")
    between, noise = moments(joined, "n", "total", "squares", F.col("m_host"))
    k_path = _strength(F.lit(mean), F.lit(between), F.lit(noise))
    return joined.select("host", "path", "n", "total", k_path.alias("k"), "host_n", "host_total", k_host.alias("k_host"), "m_host"), mean


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, evidence, site_mean, score, kept (and the kept columns).

    evidence is the classifier's probability from the whole text; site_mean the posterior of the
    document's path, the document itself taken out of its path and its host; score joins them, the site's odds in place of the
    global ones; kept is score >= THRESHOLD. host is ``source`` and path the ``lang`` under it unless
    given; null sites are one site of their own, as is the empty name. Without both labels to learn
    from all evidence is even, and every document is kept. A null text is empty; repeated rows count
    as often as they occur; other columns are ignored.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    scored = written(evidence(docs, fit(docs, labels), host, path, *keep), "quality-evidence")
    sites, mean = site_posteriors(scored)
    sites = written(sites, "quality-posteriors")
    p = 1 / (1 + F.exp(-F.col("logit")))
    joined = scored.join(small_or_shuffled(sites, 200_000), ["host", "path"])
    host_alone = (F.col("k_host") * mean + F.col("host_total") - p) / (F.col("k_host") + F.col("host_n") - 1)
    alone = (F.col("k") * host_alone + F.col("total") - p) / (F.col("k") + F.col("n") - 1)
    site = F.least(F.greatest(alone, F.lit(1e-3)), F.lit(1 - 1e-3))
    z = F.col("logit") + F.log(site / (1 - site)) - math.log(mean / (1 - mean))
    out = joined.select("doc_id", p.alias("evidence"), site.alias("site_mean"), (1 / (1 + F.exp(-z))).alias("score"), *keep)
    return out.withColumn("kept", F.col("score") >= THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that :func:`score` keeps, all columns.

    Rejected rows are told by a hash of their text, doc_id and site, so that repeated rows are treated
    alike; their list is broadcast if it is short, else joined by a shuffle.
    """
    key = F.xxhash64(F.lit(2), "doc_id", "text", "source", "lang")
    (name,) = unused(docs, "_row_key")
    rejected = written(score(docs.withColumn(name, key), labels, keep=(name,)).where("NOT kept").select(name).distinct(), "quality-rejected")
    return docs.withColumn(name, key).join(small_or_shuffled(rejected), name, "left_anti").select(*docs.columns)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
