"""The pipeline's stages, each against a plain version of its decision on its own input."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from lectio.llm import packing, quality_classifier, quality_rules, simhash
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_simhash import slow_components, slow_print


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdl") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(6, 20))) + "."
    common = sentence()
    rows = []
    for i in range(60):
        body = [sentence() for _ in range(rng.randint(3, 8))] + ([common] if i % 3 == 0 else [])
        rows.append([i, "\n".join(body)])
    rows += [[100 + i, rows[i][1]] for i in range(5)]
    rows += [[200, "few words"], [201, "spam ham " * 4000], [202, None], [203, ""], [None, sentence() + sentence() + sentence()], [3, rows[3][1]]]
    bad = [[300 + i, " ".join(w.upper() + "%%%" for w in rng.choices(words, k=60))] for i in range(15)]
    table = [(i, t, "en", f"s{(i or 0) % 4}", None if t is None else len(t)) for i, t in rows + bad]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    marks = [(i, 0 if i >= 300 else 1, 0) for i, _ in rows + bad if i is not None and (i < 60 or i >= 300)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "simhash_near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")

    import zstandard

    compressor = zstandard.ZstdCompressor(level=3)
    good = steps["quality_rules"](spark, docs, sf_dir)
    assert good.columns == columns
    assert sorted(texts(good), key=key) == sorted(((i, t) for i, t in texts(docs) if quality_rules.measured(t or "", compressor)[6]), key=key)

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    better = steps["quality_classifier"](spark, good, sf_dir)
    assert better.columns == columns
    kept = [r.doc_id for r in quality_classifier.score(good, labels).collect() if r.kept]
    assert sorted(i or -1 for i, _ in texts(better)) == sorted(i or -1 for i in kept)
    assert not {i for i, _ in texts(better) if i and i >= 300} and {i for i, _ in texts(good)} >= set(range(4, 60))

    before = sorted(set(texts(better)), key=key)
    once = steps["line_dedup"](spark, better, sf_dir)
    assert once.columns == columns and once.count() == better.count()
    gone = slow_lines(before)
    expected = {(i, "\n".join(x for pos, x in enumerate(t.split("\n")) if (-1 if i is None else i, pos) not in gone)) for i, t in before}
    assert set(texts(once)) == expected and all(r.n_chars == len(r.text) for r in once.collect())

    single = steps["simhash_near_dedup"](spark, once, sf_dir)
    assert single.columns == columns
    prints = {i: slow_print(t) for i, t in set(texts(once)) if i is not None}
    roots = slow_components(prints)
    assert sorted(i for i, _ in texts(single) if i is not None) == sorted(set(roots.values()))

    pieces = steps["packing"](spark, single, sf_dir)
    whole = packing.word_tokenizer(corpus_pipeline.TOKENIZER)
    totals = {i: len(whole.encode([t.encode()])[0]) // 4 + 1 for i, t in texts(single)}
    got = {}
    for r in pieces.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == totals
    assert simhash.DISTANCE == 3


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "sequence_id", "ids"} <= set(rows[0].asDict())
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
