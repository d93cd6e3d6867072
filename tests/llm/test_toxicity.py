"""Toxicity: voters, label model and held-out accuracy on a small corpus."""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np

from lectio.llm import toxicity as tox


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(10, 120))
        toxic = int(i % 4 == 0)
        if toxic:
            bad = rng.choice([["idiot", "moron", "trash"], ["vokkabo", "vokkari", "vokkalu", "vokkaze"]])
            for w in rng.sample(bad, 3):
                words.insert(rng.randint(0, len(words)), w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def planted(rows, rates, rng, prior):
    """Votes of independent voters with the given (toxic, clean) rates, and the hidden classes."""
    y = rng.random(rows) < prior
    return np.stack([rng.random(rows) < np.where(y, high, low) for high, low in rates], 1), y


def test_label_model_finds_planted_rates_and_a_correlated_pair():
    rng = np.random.default_rng(1)
    rates = [(0.7, 0.01), (0.6, 0.02), (0.5, 0.005), (0.4, 0.01), (0.65, 0.03)]
    votes, y = planted(20_000, rates, rng, 0.15)
    votes = np.c_[votes, votes[:, 4]]  # the sixth voter repeats the fifth
    pairs = votes.astype(float).T @ votes
    model = tox.LabelModel(6).fit(votes[:6000].astype(float), pairs.diagonal(), pairs, 20_000)
    high, low = model.accuracy
    assert np.abs(high - [*(a for a, _ in rates), rates[4][0]]).max() < 0.06
    assert np.abs(low - [*(b for _, b in rates), rates[4][1]]).max() < 0.015
    strongest = np.unravel_index(model.correlation.argmax(), (6, 6))
    assert set(strongest) == {4, 5} and model.discount[4] < 0.8 < model.discount[:4].min()
    q = model.posterior(votes.astype(float))
    assert ((q > 0.5) == y).mean() > 0.96
    assert model.posterior(np.eye(6)[[0]])[0] > model.posterior(np.eye(6)[[4]])[0]


def test_profiles_keep_kinds_of_toxic_text_apart():
    """Voters of two languages never speak together; each language is a class of its own."""
    rng = np.random.default_rng(2)
    one, y1 = planted(6000, [(0.6, 0.004)] * 4, rng, 0.1)
    two, y2 = planted(6000, [(0.6, 0.004)] * 4, rng, 0.1)
    votes = np.r_[np.c_[one, np.zeros((6000, 4), bool)], np.c_[np.zeros((6000, 4), bool), two]].astype(float)
    pairs = votes.T @ votes
    model = tox.LabelModel(8).fit(votes, pairs.diagonal(), pairs, 12_000)
    assert model.rates.shape[0] >= 3 and ((model.posterior(votes) > 0.5) == np.r_[y1, y2]).mean() > 0.97


def test_scores(spark):
    rows, labels = corpus()
    rows += [(900, None, None, None), (901, "", "en", "s"), (902, "idiot " * 30_000, "en", "s"), (None, "moron trash idiot", "en", "s"), (5, rows[5][1], "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = tox.score(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [i for i, _, _ in labels if crc32(str(i).encode()) % 5 == 0]
    assert all(by_id[i].held_out for i in held) and not by_id[1 if 1 not in held else 2].held_out
    right = sum(by_id[i].predicted == labels[i][2] for i in held)
    assert right >= 0.95 * len(held)
    assert by_id[900].predicted == by_id[901].predicted == 0 and by_id[None].predicted == 1


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    flipped = [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    frames = [spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (labels, flipped)]
    one, two = ({r.doc_id: r.score for r in tox.score(docs, f).collect()} for f in frames)
    assert one == two


def test_targets_are_posteriors(spark, monkeypatch):
    """A label that proposes nothing changes nothing: targets come from votes alone."""
    monkeypatch.setattr(tox, "LABELLED_ROWS", 150)
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    sampled = {r.doc_id for r in tox.sample(docs, frame(labels)).collect() if r.y is not None}
    assert len(sampled) == 150
    flipped = [(i, q, t if i in sampled else 1 - t) for i, q, t in labels]
    one, two = ({r.doc_id: r.score for r in tox.score(docs, frame(x)).collect()} for x in (labels, flipped))
    assert one == two
    seen = {}
    monkeypatch.setattr(tox.Linear, "fit", lambda self, rows, targets, weights: (seen.update(t=targets), setattr(self, "weights", np.zeros(self.n)), setattr(self, "constant", 0.0), self)[-1])
    _, model = tox.fit(docs, frame(labels))
    assert len(seen["t"]) == 300 and ((seen["t"] > 0.01) & (seen["t"] < 0.99)).any() and model.n > 10


def test_threshold():
    assert tox.best_threshold(np.array([-3.0, -1, 1, 2]), np.array([0.0, 0, 1, 1])) == 0
    assert tox.best_threshold(np.array([-3.0, -2, -2, -1]), np.array([0.0, 0, 0, 1])) == -1.5


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "hello there")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.predicted for r in tox.score(docs, none).collect()} == {1: 1, 2: 0}
    assert tox.score(docs.limit(0), none).count() == 0
