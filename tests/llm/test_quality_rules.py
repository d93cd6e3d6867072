"""Quality rules: counts against a slow version, bands on plain, repetitive and random text."""

from __future__ import annotations

import base64
import random
import re

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from lectio.llm import quality_rules as rules

COMPRESSOR = zstandard.ZstdCompressor(level=3)


def slow(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = text.split("\n")
    duplicate = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicate, len(inside), failed


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "bb", "é#", " ", "  ", "\n", "\n\n", " \n", "\x0b", "\x1c", "\x85", "a b c d e f g h i ", "🙂<"]), max_size=60).map("".join))
def test_counts(text):
    assert rules.measured(text, COMPRESSOR)[:6] == slow(text)


def prose(n: int, seed: int = 1) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_bands():
    kept = lambda text: rules.measured(text, COMPRESSOR)[6]
    assert all(kept(prose(n)) for n in (25, 60, 200, 1000, 20_000))
    rng = random.Random(4)
    assert not kept(" ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(200)))
    assert not kept(" ".join(f"item {i % 7} again" for i in range(400)))
    assert not kept(prose(300) + " ".join(["spam ham"] * 9000))
    assert not kept("") and not kept("few words only")
    for share in (2, 3, 5):  # a half, a third, a fifth of encoded bytes inside plain prose
        plain = prose(5000)
        junk = base64.b64encode(rng.randbytes(len(plain) * 3 // (4 * (share - 1)))).decode()
        lines = "\n".join(junk[k : k + 76] for k in range(0, len(junk), 76))
        assert not kept(f"{plain[:9000]}\n{lines}\n{plain[9000:]}")
    for size in (4097, 6143, 6144, 8193, 12_289):
        assert kept(prose(size)[: size - 1] + "."), "a short last chunk is judged with the one before"


def test_documents(spark):
    rows = [(1, prose(100), "x"), (2, None, "y"), (3, "", "z"), (None, prose(50, 2), "w"), (1, prose(100), "x"), (5, prose(40_000), "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = rules.quality(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 50, True), (1, 100, True), (1, 100, True), (2, 0, False), (3, 0, False), (5, 40_000, True)]
    good = rules.keep_good(docs)
    assert good.schema == docs.schema and good.count() == 4
    assert rules.quality(docs.limit(0)).count() == rules.keep_good(docs.limit(0)).count() == 0
