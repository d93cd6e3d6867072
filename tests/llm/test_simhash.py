"""SimHash: fingerprints and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from lectio.llm import simhash


def slow_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_match_a_slow_version():
    texts = ["", "  \n", "One", "one two", "A b C", "a b c d", "É é x\u001cy z " * 300, "x " * 40_000, "word\tother\x0bthird fourth"]
    got = simhash.fingerprints_of([t.encode() for t in texts] + [None])
    assert got.tolist() == [slow_print(t) for t in texts] + [0]


def test_masks_cover_every_close_pair():
    masks = simhash.masks_within(2**64 - 1)
    rng = random.Random(3)
    for _ in range(500):
        difference = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not difference & m for m in masks)


@pytest.mark.parametrize("bucket", [1024, 20])
def test_components_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    bases = [rng.getrandbits(64) for _ in range(6)]
    prints = {i: bases[i % 6] ^ sum(1 << rng.randrange(12 if i % 6 == 0 else 64) for _ in range(rng.randrange(5))) for i in range(300)}
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in set(prints.values())]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long")).collect()
    assert all(((a ^ b) & (2**64 - 1)) for a, b in edges)
    values = sorted(set(prints.values()))
    expected = slow_components({v: v for v in values})
    linked: dict[int, int] = {v: v for v in values}

    def find(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a % 2**64), find(b % 2**64)))
        linked[y] = x
    assert {v: find(v) for v in values} == expected


def test_documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(600)]
    rows = [(10, " ".join(base), "a"), (4, " ".join([*base[:300], "changed", *base[301:]]), "b"), (7, None, None), (3, "", "c"), (9, "Short text", "d"), (2, "short TEXT", "e"), (2, "short TEXT", "e"), (None, "a b c d e", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {k: slow_print(t) for k, t, _ in rows if k is not None}
    expected = slow_components(prints)
    for row in got:
        if row.doc_id is not None:
            assert (row.fingerprint, row.component_id) == (format(prints[row.doc_id], "016x"), expected[row.doc_id])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {expected[i] for i in prints} | {None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_drops_rows_not_ids(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(900)) for _ in range(200)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (7, a), (7, d), (7, d), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (None, b), (None, c), (7, d), (9, None)], key=str)


def test_columns_of_any_name(spark):
    rows = [(1, "one two three four", 1, 2, 3), (2, "one two three four", 1, 2, 3), (2, "one two three four", 1, 2, 3), (5, "else altogether here now", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, other int, n int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]
