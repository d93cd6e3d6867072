"""MinHash near-duplicates against all pairs of sets, in small and in large groups."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from lectio.llm import blocks, minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*[words[k:] for k in range(width)], strict=False)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def slow(rows):
    """{doc_id: (size of its set, component)} by all pairs."""
    sets = {i: shingles(text) for i, text in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, families=6, copies=18, size=60):
    """Families of texts with more and fewer changed words, around and at both sides of the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopéß") for _ in range(rng.randint(1, 8)))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(3, size))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), rng.choice((" ", "\n", "\t ")).join(w.upper() if rng.random() < 0.1 else w for w in text)))
    rng.shuffle(rows)
    return rows


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, **more).collect()}


def expected(rows):
    return {i: (n, c, i == c) for i, (n, c) in slow(rows).items()}


@pytest.mark.parametrize(("block", "anchors"), [(1024, 16), (8, 2)])
def test_equals_all_pairs(spark, monkeypatch, block, anchors):
    """Groups of one block, and the same groups cut into blocks of eight rows."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    monkeypatch.setattr(blocks, "ANCHORS", anchors)
    rows = corpus(1)
    assert found(spark, rows) == expected(rows)


def test_heavy_sets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_WEIGHT", 200)
    rows = corpus(2, families=3)
    assert found(spark, rows) == expected(rows)


def test_unusual_rows(spark):
    long = "one two three four five " * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "WORD"), (6, "word word"), (7, "É é"), (8, "é É"), (9, long), (10, long + "end"), (11, "a b c"), (12, "a  b\tc")]
    assert found(spark, rows) == expected(rows)


def test_repeated_and_null_ids_and_extra_columns(spark):
    text = "the same text stands here more than once"
    rows = [(5, text, 1, "x"), (5, text, 2, "y"), (None, text, 3, "z"), (7, text + " twice", 4, "w"), (5, "another text altogether", 5, "v"), (None, "alone here", 6, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, component_id string")
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    n = len(shingles(text))
    assert got == sorted([(5, n, 5, True), (5, n, 5, True), (None, n, 5, False), (7, n + 1, 5, False), (5, 2, 5, True), (None, 1, None, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_wider_shingles(spark):
    rows = corpus(4, families=2)
    sets = {i: shingles(t, 5) for i, t in rows}
    assert {i: n for i, (n, _, _) in found(spark, rows, width=5).items()} == {i: len(s) for i, s in sets.items()}


def test_posterior_bounds():
    """The mass above the threshold, by a sum over a fine grid, against the binomial form."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, least in zip(range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH), minhash.least_agreement(), strict=True):
        for m, stays in ((least, True), (least - 1, False)):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid) + math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
            assert (np.exp(log)[grid >= 0.8].sum() / len(grid) >= minhash.MISS) == stays
    assert list(minhash.least_agreement()) == sorted(minhash.least_agreement())


def test_recall_of_bands_and_batches():
    """Pairs at the threshold share a band and survive all batches."""
    rng = np.random.default_rng(5)
    kept = 0
    for _ in range(300):
        shared, own = rng.integers(0, 2**63, 80, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
        minima = minhash.signatures([np.unique(np.r_[shared, own[:10]]), np.unique(np.r_[shared, own[10:]])])
        bands = minhash.band_keys(minima)
        i, _ = minhash._survivors(minima.astype(np.uint8), np.array([0]), np.array([1]))
        kept += bool((bands[0] == bands[1]).any()) and len(i) == 1
    assert kept == 300
