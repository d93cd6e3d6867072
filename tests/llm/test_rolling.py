"""Rolling features against a slow version, and the skip list against a sorted list."""

from __future__ import annotations

import random
import zlib

import pytest

from lectio.llm import rolling


def test_skip_list_is_a_sorted_list():
    rng = random.Random(4)
    held, plain = rolling.SkipList(), []
    for _ in range(4000):
        if plain and rng.random() < 0.45:
            value = rng.choice(plain)
            n = rng.randint(1, plain.count(value))
            held.add(value, -n)
            for _ in range(n):
                plain.remove(value)
        else:
            value, n = rng.randint(-50, 200), rng.randint(1, 3)
            held.add(value, n)
            plain += [value] * n
        plain.sort()
        assert (held.size, held.total) == (len(plain), sum(plain))
        if plain:
            for rank in (1, len(plain), rng.randint(1, len(plain))):
                assert held.number(rank) == plain[rank - 1]
    while plain:
        held.add(plain.pop(), -1)
    assert held.size == held.total == 0 and all(x is None for x in held.head[2]) and not any(held.head[3])


def slow(rows, windows):
    """rows: (doc_id, source, event_s, length, lang)."""
    out = []
    for i, source, at, _, _ in rows:
        for w in windows:
            seen = [r for r in rows if r[1] == source and at - w <= r[2] < at]
            lengths = sorted(r[3] for r in seen if r[3] is not None)
            m = len(lengths)
            out.append((i, w, at, len(seen), sum(lengths), len({r[4] for r in seen} - {None}), lengths[(m + 1) // 2 - 1] if m else None, lengths[(99 * m + 99) // 100 - 1] if m else None))
    return sorted(out, key=str)


def event_s(i):
    return 60 * ((i + zlib.crc32(str(i).encode()) % 1000) // 6)


@pytest.mark.parametrize(("windows", "segment"), [((1800, 86_400), 21_600), ((1800, 86_400), 60), ((60, 7200), 500)])
def test_equals_the_slow_version(spark, windows, segment):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "a", None]), None if rng.random() < 0.1 else "é" * rng.randint(0, 9), rng.choice(["en", "de", None])) for i in rng.sample(range(9000), 150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").repartition(3)
    got = sorted(map(tuple, rolling.window_features(docs, windows, segment).collect()), key=str)
    assert got == slow([(i, s, event_s(i), None if t is None else len(t), g) for i, s, t, g in rows], windows)


def test_repeated_rows_long_texts_and_extra_columns(spark):
    rows = [(i % 40, "one", "x" * (200_000 if i == 7 else i), "en", i, "y") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string, lang string, n_chars int, line string")
    got = sorted(map(tuple, rolling.window_features(docs).collect()), key=str)
    assert got == slow([(i, s, event_s(i), len(t), g) for i, s, t, g, *_ in rows], (1800, 86_400))
    assert rolling.window_features(docs.limit(0)).collect() == []


def test_equal_events_are_one_group(spark):
    """A moment with very many events of few kinds is a few rows."""
    rows = spark.range(20_000).selectExpr("'l' AS line", "cast(60 * (id % 3) AS long) AS event_s", "cast(id % 5 AS long) AS length", "'en' AS lang")
    got = {(r.window_s, r.event_s): tuple(r)[3:] for r in rolling.rolling(rows, (60, 120), 60).collect()}
    sizes = [rows.where(f"event_s = {60 * k}").count() for k in range(3)]
    assert got[(60, 0)] == (0, 0, 0, None, None) and got[(60, 120)][0] == sizes[1] and got[(120, 120)][0] == sizes[0] + sizes[1]
    assert got[(120, 120)][3:] == (2, 4)
