"""Licence scan against a slow scan of every block."""

from __future__ import annotations

import random
import re

import numpy as np

from lectio.llm import license_scan as scan


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_places(words):
    return sorted((label, i) for phrase, label in scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def slow_blocks(words):
    """(template, start, containment) of each block that meets its template's threshold."""
    out = set()
    for k, (_, wording) in enumerate(scan.TEMPLATES):
        parts = wording.split()
        distinct = set(parts)
        for start in range(max(1, len(words) - len(parts) + 1)):
            share = len(distinct & set(words[start : start + len(parts)])) / len(distinct)
            if share >= scan.CONTAINMENT:
                out.add((k, start, share))
    return out


def texts():
    rng = random.Random(6)
    filler = ["the", "of", "and", "license", "software", "under", "version", "mit", "public", "general", "x", "2", "0", "été"]
    for _ in range(120):
        words = rng.choices(filler, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            wording = rng.choice(scan.TEMPLATES)[1].split()
            wording = [w for w in wording if rng.random() > rng.choice([0, 0, 0.1, 0.3])]
            at = rng.randint(0, len(words))
            words[at:at] = wording
        yield rng.choice([" ", "\n", ", ", "-"]).join(words).title()
    yield from (None, "", "MIT License", "mit-license MIT\nLICENSE gnu general public license", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "z " * 100_000 + "Released under the MIT License.")


def test_scan(spark):
    given = list(texts())
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").selectExpr("*", "'a' AS matches")
    got = {r.doc_id: r for r in scan.scan(docs).collect()}
    assert len(got) == len(given)
    for i, text in enumerate(given):
        words = slow_words(text)
        assert got[i].n_words == len(words)
        assert sorted((p.label, p["first"]) for p in got[i].places) == slow_places(words)
        if len(words) > 1000:
            assert [m.label for m in got[i].matches] == ["mit"]
            continue
        blocks = slow_blocks(words)
        length = {k: len(w.split()) for k, (_, w) in enumerate(scan.TEMPLATES)}
        covered = {(k, p) for k, start, _ in blocks for p in range(start, min(start + length[k], len(words)))}
        assert {(m.template, p) for m in got[i].matches for p in range(m["first"], m["first"] + m.n_words)} == covered
        for m in got[i].matches:
            assert m.containment == max(c for k, s, c in blocks if k == m.template and m["first"] <= s < m["first"] + m.n_words)


def test_query(spark, tmp_path):
    rows = [(1, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (2, None), (3, "nothing here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in scan.op3_license_scan(spark, str(tmp_path)).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].first_word, got[1].last_word, got[1].score) == ("mit", "cc-by-nc,mit", 3, 3, 1.0)
    assert (got[2].n_words, got[2].labels, got[2].first_word, got[2].score) == (0, "", None, 0.0)


def test_short_notices_with_a_word_missing(spark, tmp_path):
    told = {
        "Licensed under Creative Commons Attribution 4.0 International License": "cc-by",
        "available under the terms of the Eclipse Public License": "epl",
        "released under MIT license": "mit",
        "Licensed under the Apache License, 2.0": "apache",
        "Licensed under a Creative Commons Attribution-ShareAlike International License": "cc-by-sa",
        "Licensed under a Creative Commons Attribution Non-Commercial 4.0 International License": "cc-by-nc",
        "Licensed under CC BY-ND 4.0": "cc-by-nd",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
        "made available under the terms of the Foo Public License": "",
        "this is free software released into the public domain": "",
        "released under the same license": "",
        "under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    }
    spark.createDataFrame(list(enumerate(told)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in scan.op3_license_scan(spark, str(tmp_path)).collect()}
    assert {text: got[i].labels for i, text in enumerate(told)} == told
    assert abs(got[0].score - 0.9) < 1e-9 and abs(got[1].score - 8 / 9) < 1e-9 and got[8].score >= 0.8


def test_positional_filter_rejects_blocks_before_they_are_counted():
    index = scan.TemplateIndex({w: 1 for w in scan.VOCABULARY})
    wording = scan.TEMPLATES[6][1].encode().split()
    need, first = index.templates[6][3], min(index.templates[6][1], key=index.templates[6][1].get)
    early = [w for w in index.place if index.place[w] < index.place[first]]
    words = [b"zzz"] * 40 + [first] + [b"zzz"] * 40 + early[: len(wording)] + [first] + early[: len(wording)] + [b"zzz"] * 40 + wording + [b"zzz"] * 40
    at = np.array([k for k, w in enumerate(words) if w == first])
    held = np.r_[0, np.cumsum([index.place.get(w, -1) >= index.place[first] for w in words])]
    ranges = index.near([(held, at)], len(wording), need)
    place = words.index(wording[0], at[1] + len(wording) + 1)
    # none around the lone seed, nor around the one among words that come before it in the order
    assert ranges and all(place - len(wording) < a <= b < place + len(wording) for a, b in ranges)


def test_stretches_of_other_licences_are_matches_without_a_label(spark, tmp_path):
    texts = ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in scan.op3_license_scan(spark, str(tmp_path)).collect()}
    assert got[0].labels == "cc-by-nc-sa" and got[0].score == 1.0
    assert got[1].labels == "" and got[1].score >= 0.8 and got[1].n_matches > 0


def test_edges(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "MIT License"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, len(r.places), [m.label for m in r.matches]) for r in scan.scan(docs).collect()]
    assert sorted(got, key=str) == [(1, 1, ["mit"]), (1, 1, ["mit"]), (2, 0, []), (None, 1, [])]
    assert scan.scan(docs.limit(0)).count() == 0
