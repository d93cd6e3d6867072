"""Importance resampling against a slow version; SQL in test_queries_sql."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lectio.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, low, high):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), Counter(" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1))


def slow(docs, target, low, high, buckets, share, min_words, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for texts, sums in ((docs, s), (target, t)):
        for row in texts:
            for f, n in runs(row[-1], low, high)[1].items():
                sums[of(f)] += n
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in docs:
        n_words, counts = runs(text, low, high)
        n = sum(counts.values())
        weight = sum(k * gain(of(f)) for f, k in counts.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, n_words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[2] >= min_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for place, r in enumerate(fit[: len(fit) * share[0] // share[1]]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=str)


def corpus(seed, n=90):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh1é") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    return [" ".join(rng.choice(words[:: 1 + i % 3]) for _ in range(rng.randint(0, 60))).replace("a ", "A, ").replace("b ", "b-") for i in range(n)]


@pytest.mark.parametrize(("low", "high", "buckets", "often"), [(1, 1, 10_000, 100_000), (1, 2, 97, 1000), (2, 3, 1000, 20), (1, 1, 10_000, 0)])
def test_equals_the_slow_version(spark, low, high, buckets, often):
    """One and several words; every feature broadcast, and only the most frequent ones."""
    docs, target = list(enumerate(corpus(1))), list(enumerate(corpus(2, 20)))
    docs += [(200, None), (201, ""), (202, "!?"), (203, "word " * 30_000)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = resampling.resample(frame(docs), frame(target), low, high, buckets, (30, 100), 15, 7, often)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "n_words", "weight", "score", "rank").collect()), key=str) == slow(docs, target, low, high, buckets, (30, 100), 15, 7)


def test_repeated_rows_null_ids_and_extra_columns(spark):
    texts = corpus(3, 12)
    rows = [(k % 5 if k % 4 else None, t, 1, "x", 2.0) for k, t in enumerate(texts)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight int, feature string, h1 double")
    target = spark.createDataFrame([(1, "aa bb", 1)], "item_id long, text string, n int")
    got = resampling.resample(docs, target, share=(50, 100), min_words=5)
    expected = slow([r[:2] for r in rows], [(1, "aa bb")], 1, 1, 10_000, (50, 100), 5, 2024)
    plain = lambda found: sorted([r[:5] for r in found], key=str)
    found = sorted((tuple(r[c] for c in ("doc_id", "n_features", "n_words", "weight", "score", "rank")) for r in got.collect()), key=str)
    assert plain(found) == plain(expected)
    ranked = sorted((r for r in found if r[5]), key=lambda r: r[5])
    assert [r[5] for r in ranked] == [r[5] for r in sorted((r for r in expected if r[5]), key=lambda r: r[5])] and [r[4] for r in ranked] == sorted((r[4] for r in ranked), reverse=True)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    row = resampling.resample(some, none, share=(100, 100)).first()
    assert (row.n_features, row.weight, row["rank"]) == (40, slow([(1, "one two " * 20)], [], 1, 1, 10_000, (1, 1), 20, 2024)[0][3], 1)
