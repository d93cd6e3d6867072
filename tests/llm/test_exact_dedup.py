"""Exact duplicates: the filter against a counter, groups against a dictionary."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectio.llm.exact_dedup import RANGE_ROWS, exact_groups, range_bits, repeated_fingerprints
from lectio.llm.quotient import CountingQuotientFilter


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5) | st.sampled_from([2**63, 2**64 - 1])), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    filters = [CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(np.array(p, np.uint64)).to_bytes()) for p in parts]
    whole = filters[0].merge(filters[1:])
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist(), strict=True)) == Counter(x for p in parts for x in p)


def test_ranges_follow_the_rows():
    assert range_bits(0) == range_bits(RANGE_ROWS) == 2
    for rows in (10**7, 10**9, 3 * 10**10):
        assert RANGE_ROWS / 4 < rows / 2 ** range_bits(rows) <= 2 * RANGE_ROWS


def test_merging_sorts_nothing_again(monkeypatch):
    rng = np.random.default_rng(1)
    filters = [CountingQuotientFilter.build(rng.integers(0, 5000, 3000).astype(np.uint64) << np.uint64(50)) for _ in range(5)]
    monkeypatch.setattr(np, "argsort", None)
    whole = filters[0].merge(filters[1:])
    assert int(whole.counts.sum()) == 15_000 and (np.diff(whole.fingerprints().astype(object)) > 0).all()


def test_repeated_fingerprints(spark):
    values = [5, 5, -1, -1, -1, 9, 2**62]
    got = repeated_fingerprints(spark.createDataFrame([(v,) for v in values], "f long").repartition(3)).collect()
    assert {tuple(r) for r in got} == {(5, 2), (-1, 3)}


def test_groups(spark):
    rows = [(3, "a  b", 1), (1, "a\n\tb", 2), (2, "a b ", 3), (5, None, 4), (4, "", 5), (6, "x" * 200_000, 6), (7, "x" * 200_000, 7), (7, "x" * 200_000, 8), (None, "only", 9), (None, "a b", 10), (8, "a b", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int")
    got = exact_groups(docs).collect()
    assert len(got) == len(rows)
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_groups(docs.limit(0)).count() == 0
    shuffled = exact_groups(docs, broadcast_rows=0).collect()
    assert Counter(map(tuple, shuffled)) == Counter(map(tuple, got))
