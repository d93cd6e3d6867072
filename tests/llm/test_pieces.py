"""Encoding against the library: ids, decoded text, alignment, and a model with a character map."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lectio.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = pieces.PieceEncoder(PATH)
texts = st.lists(st.sampled_from(["The", "the ", " ", "  ", "\n", "▁", "▁▁", "é", "ﬁ", "①", "　", "ｶﾞ", "<s>", "</s>", "\t", "🙂", "\x00", "1234", "…", "Å"]) | st.text(max_size=6), max_size=14).map("".join)


@settings(deadline=None, max_examples=500)
@given(texts)
def test_ids_and_decoded_text_are_the_librarys(text):
    values = [text, "x  y", "", text]
    done = OWN.encode(values)
    for value, ids, decoded, lengths, digits in zip(values, *done, strict=True):
        expected = LIBRARY.encode(value)
        assert ids.tolist() == expected and len(lengths) == len(expected)
        assert decoded.decode() == LIBRARY.decode(expected) and digits.decode() == ",".join(map(str, expected))


@settings(deadline=None, max_examples=200)
@given(texts)
def test_spans_cover_the_source(text):
    lengths = OWN.encode([text]).lengths[0]
    begins, ends = OWN.spans(text, lengths)
    data = text.encode()
    assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data
    for piece, a, b in zip((OWN.bytes_of[i] for i in LIBRARY.encode(text)), begins, ends, strict=True):
        assert piece.replace(pieces.SPACE_BYTES, b" ").lstrip(b" ") == data[a:b].replace(pieces.SPACE_BYTES, b" ").lstrip(b" ")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_follows_the_character_map(rule, squeeze):
    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    except AttributeError:
        pytest.skip("this library has no normaliser of its own")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = pieces.Normaliser(proto.normalizer_spec)

    @settings(deadline=None, max_examples=300)
    @given(texts)
    def same(text):
        normal, align = own.aligned(text)
        assert normal == library.normalize(text) == own(text)
        assert len(align) == len(normal.encode()) + 1 and (np.diff(align) >= 0).all()

    same()


def test_runs_and_words_of_any_length():
    values = ["a" * n + " " * n + "é" * n + "\n" * n for n in (1, 2, 63, 64, 65, 66, 300)] + ["the quick brown fox " * 3000, "▁" * 70, " ", "  "]
    for value, ids, decoded in zip(values, *OWN.encode(values)[:2], strict=True):
        expected = LIBRARY.encode(value)
        assert ids.tolist() == expected and decoded.decode() == LIBRARY.decode(expected)


def test_documents(spark):
    rows = [(1, "The  cat\nsat.", "x"), (2, None, "y"), (3, "", "z"), (None, "é" * 50_000, "w"), (1, "The  cat\nsat.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.decoded): r for r in pieces.encode(docs, PATH, (*pieces.OUTPUTS,)).collect()}
    for i, text, _ in rows:
        ids = LIBRARY.encode(text or "")
        row = got[i, LIBRARY.decode(ids)]
        assert row.ids == ids and row.n_tokens == len(ids) and row.span_bytes == len((text or "").encode())
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encode(docs.limit(0), PATH).count() == 0
