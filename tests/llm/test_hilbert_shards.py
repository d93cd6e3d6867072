"""Hilbert sharding: the curve's properties and the law of equal counts."""

from __future__ import annotations

from collections import defaultdict
from itertools import product
from zlib import crc32

import pytest

from lectio.llm import hilbert_shards as hs


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 3), (3, 2), (3, 3)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, n, bits):
    names = [f"c{i}" for i in range(n)]
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), ", ".join(f"{c} int" for c in names))
    rows = sorted(cells.withColumn("h", hs.hilbert_index(names, bits)).collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(1 << bits * n))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[c] - b[c]) for c in names) == 1


@pytest.mark.parametrize("part_rows", [512, 3])
def test_shards(spark, monkeypatch, part_rows):
    monkeypatch.setattr(hs, "PART_ROWS", part_rows)
    rows = [(i, "x" * (i * i % 900), "hot" if i % 3 == 0 else f"s{i % 17}", ["en", "de", None][i % 3], "e") for i in range(203)]
    rows += [(None, None, None, None, None), (5, "x" * 25, "s5", None, "e"), (900, "é" * 50_000, "s", "fr", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard string")
    got = hs.shard_documents(docs).collect()
    assert len(got) == len(rows)
    expected = sorted((i or 0, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.curve))
    assert sorted(slots) == list(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    runs = [sorted(slots[s]) for s in range(8)]
    assert all([k for k, _ in run] == list(range(len(run))) for run in runs)
    curve = [c for run in runs for _, c in run]
    assert curve == sorted(curve)
    whole = {r.shard: r for r in hs.manifest(hs.shard_documents(docs), list(hs.document_codes())).collect()}
    assert sum(r.n_rows for r in whole.values()) == len(rows)


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "s", "en"), (2, "b", "s", "en")], "doc_id long, text string, source string, lang string")
    assert sorted((r.shard, r.slot) for r in hs.shard_documents(docs).collect()) == [(0, 0), (1, 0)]
    assert hs.shard_documents(docs.limit(0)).count() == 0


def test_ranges_of_shards_let_readers_skip_most_of_them(spark):
    """Of eight shards a reader of one source, language and size needs few; shards by hash would need all."""
    rows = [(i, "x" * (10 + i * 37 % 3000), f"s{i % 12}", ["en", "de", "fr", "es"][i * 7 % 4]) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    codes = list(hs.document_codes())
    sharded = hs.shard_documents(docs).collect()
    ranges = {}
    for r in sharded:
        for c in codes:
            low, high = ranges.get((r.shard, c), (r[c], r[c]))
            ranges[r.shard, c] = min(low, r[c]), max(high, r[c])
    needed = [sum(all(ranges[s, c][0] <= r[c] <= ranges[s, c][1] for c in codes) for s in range(8)) for r in sharded[::20]]
    assert sum(needed) / len(needed) < 4 and min(needed) >= 1
