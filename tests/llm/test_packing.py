"""Packing: every id once, gapless, little padding; ids as the tokenizer gives them."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectio.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
texts = st.lists(st.sampled_from(["The", "it's", " ", "\n", "\t", " ", "　", "é", "́", "ΑΣ", "<|endoftext|>", "<|startoftext|>", "don't", "word.", "WORD,", "été...", "a.b", "ẖ", "ẖ", "99", "!?", "\x1c", "\x85", "İ", "🙂"]) | st.text(max_size=5), max_size=12).map("".join)


@settings(deadline=None, max_examples=300)
@given(texts)
def test_ids_by_chunk_are_the_tokenizers_own(text):
    got = packing.word_tokenizer(PATH).encode([text.encode()])[0]
    assert np.frombuffer(got, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def check(rows, expected):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert {k: b"".join(r["ids"] for r in sorted(v, key=lambda r: r["start"])) for k, v in by_doc.items()} == expected
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 > 0
            at += r["length"]
        assert at <= packing.LENGTH
    return len(by_sequence)


@pytest.mark.parametrize("fan_in", [256, 2])
def test_pack(spark, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "don't", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 400, 1500, 9000]))), "s") for i in range(90)] + [(90, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(5)
    got = [r.asDict() for r in packing.pack(docs, PATH).collect()]
    expected = {i: np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t, _ in rows}
    sequences = check(got, expected)
    ids = sum(map(len, expected.values())) // 4
    assert sequences * packing.LENGTH - ids <= packing.LENGTH + sequences * packing.GAP
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_best_fit_and_bounded_space():
    out = []
    packer = packing.Packer(out.append, length=10, windows=2)
    piece = lambda k, n: (k, 0, b"\0\0\0\0" * n, n)
    for k, n in enumerate((6, 7, 3)):
        packer.add(piece(k, n))
    assert [[p[0] for p in window] for window in out] == [[1, 2]]  # 3 leaves least room beside 7
    packer.add(piece(3, 25))
    assert len(packer.open) <= 2 and [len(w) for w in out[1:3]] == [1, 1]
