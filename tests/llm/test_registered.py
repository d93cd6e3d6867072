"""The registered opN_ queries themselves, each on a written table against a slow version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from lectio.llm import hilbert_shards, packing, quality_classifier, quality_rules
from lectio.llm.queries import QUERIES
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_quality_classifier import slow_sites
from tests.llm.test_simhash import slow_components, slow_print


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(700)] + ["été", "naïve", "don't", "3.14", "日本語"]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    out = []
    for i in range(70):
        lines = [sentence(rng.randint(4, 25)) for _ in range(rng.randint(1, 9))]
        if i % 6 == 0:
            lines.append("This line stands in many of the documents, word by word.")
        text = "\n".join(lines)
        out.append([i, text if i % 10 else text.upper() + "%%%", f"s{i % 3}" if i % 2 else "hot", ["en", "de", None][i % 3]])
    out += [[100 + k, out[k][1], "hot", "en"] for k in range(4)]  # copies
    out += [[110 + k, out[k][1] + " x", "hot", "en"] for k in range(4)]  # near copies
    out += [[200, None, "hot", None], [201, "", None, "en"], [202, " \n\t", "s1", "en"], [203, "word " * 30_000, "hot", "en"], [204, sentence(5), "lone", "fr"]]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("registered"))
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{where}/documents.parquet")
    marks = [(i, int(i % 10 != 0), int(i % 7 == 0)) for i in range(70)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def collected(spark, sf_dir, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}


def test_op1(spark, rows, sf_dir):
    got = collected(spark, sf_dir, "op1_toxicity")
    assert got.keys() == {r[0] for r in rows}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert got[200].score == got[201].score


def test_op2(spark, rows, sf_dir):
    got = collected(spark, sf_dir, "op2_simhash_near_dedup")
    prints = {r[0]: slow_print(r[1]) for r in rows if r[0] != 203}
    prints[203] = int(got[203].fingerprint, 16)
    roots = slow_components(prints)
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (prints[i], roots[i]) for i in prints}


def test_op4(spark, rows, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = QUERIES["op4_packing"](spark, sf_dir).collect()
    filled: dict[int, list] = {}
    for r in pieces:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert sum(x[1] for x in own) == len(ids)
        for start, length, crc, total in own:
            assert total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


def test_op5(spark, rows, sf_dir):
    got = collected(spark, sf_dir, "op5_line_dedup")
    gone = slow_lines([(r[0], r[1]) for r in rows])
    for i, text, *_ in rows:
        expected = None if text is None else "\n".join(x for pos, x in enumerate(text.split("\n")) if (i, pos) not in gone)
        assert got[i].text == expected


def test_op6(spark, rows, sf_dir):
    got = collected(spark, sf_dir, "op6_quality_rules")
    compressor = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows: dict[tuple, list] = {}
        for k in range(len(words) - 7):
            windows.setdefault(tuple(words[k : k + 8]), []).append(k)
        covered = {k + d for places in windows.values() if len(places) > 1 for k in places for d in range(8)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed)
        data = text.encode()
        inside = lambda part: (lambda low, high: low <= len(compressor.compress(part)) / len(part) <= high)(*next(b[1:] for b in quality_rules.BANDS if len(part) <= b[0]))
        chunks = [data[k : k + 4096] for k in range(0, len(data), 4096)]
        if len(chunks) > 1 and len(chunks[-1]) < 2048:
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        chunks = chunks if len(chunks) > 1 else []
        assert r.kept == (not failed and inside(data) and sum(not inside(c) for c in chunks) <= quality_rules.BAD_CHUNKS * len(chunks))


def slow_curve(codes: list[int], bits: int) -> int:
    """Skilling's transform, coordinate by coordinate."""
    x, n = list(codes), len(codes)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def test_op7(spark, rows, sf_dir):
    got = collected(spark, sf_dir, "op7_hilbert_sharding")
    placed = []
    for i, text, source, lang in rows:
        data = (text or "").encode()
        size = len(data) + 1
        codes = [zlib.crc32((source or "").encode()) % 32, zlib.crc32((lang or "").encode()) % 32, min(int(2 * math.log2(size)), 31)]
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard, [r.source_code, r.lang_code, r.size_code]) == (size, zlib.crc32(data), "rows", None, codes)
        assert r.curve == slow_curve(codes, hilbert_shards.BITS)
        placed.append((r.curve, i))
    short, longer = divmod(len(rows), 8)
    expected = [(shard, slot) for shard in range(8) for slot in range(short + (shard < longer))]
    assert [(got[i].shard, got[i].slot) for _, i in sorted(placed)] == expected


def test_op8(spark, rows, sf_dir):
    got = collected(spark, sf_dir, "op8_quality_classifier")
    compressor = zstandard.ZstdCompressor(level=3)
    features = {r[0]: quality_classifier.features_of(r[1] or "", compressor) for r in rows}
    known = sorted((i % 10 != 0, features[i]) for i in range(70))
    model = quality_classifier.Classifier(np.array([x for _, x in known]), np.array([float(y) for y, _ in known]))
    logits = {i: float(model.logit(np.array([x]))[0]) for i, x in features.items()}
    sites, mean = slow_sites([(r[2] or "", r[3] or "", logits[r[0]]) for r in rows])
    for i, _, source, lang in rows:
        n, total, k, host_n, host_total, k_host, _ = sites[source or "", lang or ""]
        p = 1 / (1 + math.exp(-logits[i]))
        host = (k_host * mean + host_total - p) / (k_host + host_n - 1)
        site = min(max((k * host + total - p) / (k + n - 1), 1e-3), 1 - 1e-3)
        z = logits[i] + math.log(site / (1 - site)) - math.log(mean / (1 - mean))
        assert got[i].site_mean == pytest.approx(site, abs=1e-6) and got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        assert got[i].kept == (got[i].score >= 0.5)


def test_op9(spark, rows, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = collected(spark, sf_dir, "op9_sentencepiece")
    for i, text, *_ in rows:
        ids = library.encode(text or "")
        assert got[i].n_tokens == len(ids) and got[i].span_bytes == len((text or "").encode())
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op10(spark, rows, sf_dir):
    got = collected(spark, sf_dir, "op10_exact_dedup")
    groups: dict[str, list] = {}
    for i, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    for body, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(body.encode()).hexdigest())
