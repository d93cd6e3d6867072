"""Empirical Bayes against a plain version; the classifier on a small corpus."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lectio.llm import quality_classifier as qc


def slow_sites(rows):
    """{(host, path): (n, total, k, host_n, host_total, k_host, m_host)} and the mean, from (host, path, logit) rows."""
    p = {}
    for host, path, z in rows:
        p.setdefault((host, path), []).append(1 / (1 + math.exp(-z)))
    hosts = {}
    for (host, _), values in p.items():
        hosts.setdefault(host, []).extend(values)
    every = [x for v in p.values() for x in v]
    mean = np.mean(every)

    def strength(groups):
        between = sum(len(v) * (np.mean(v) - c) ** 2 for v, c in groups) / len(every)
        noise = sum(np.var(v) for v, _ in groups) / len(every)
        return min(max(mean * (1 - mean) / max(between - noise, 1e-9) - 1, 1.0), 1e6)

    k = strength([(v, mean) for v in hosts.values()])
    m = {h: (k * mean + sum(v)) / (k + len(v)) for h, v in hosts.items()}
    k_path = strength([(v, m[h]) for (h, _), v in p.items()])
    return {g: (len(v), sum(v), k_path, len(hosts[g[0]]), sum(hosts[g[0]]), k, m[g[0]]) for g, v in p.items()}, mean


def test_posteriors_match_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(h, f"p{rng.randrange(3)}", rng.gauss(2 if h == "good" else -1 if h == "bad" else 0, 1)) for h in ("good", "bad", "x", "hot") for _ in range(90 if h == "hot" else rng.randint(1, 25))]
    sites, mean = qc.site_posteriors(spark.createDataFrame(rows, "host string, path string, logit double"))
    expected, expected_mean = slow_sites(rows)
    assert mean == pytest.approx(expected_mean)
    got = {(r.host, r.path): (r.n, r.total, r.k, r.host_n, r.host_total, r.k_host, r.m_host) for r in sites.collect()}
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        assert got[key] == pytest.approx(values)


def corpus(n=160):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        body = rng.choices(words, k=rng.randint(25, 200))
        good = int(i % 4 != 0)
        if not good:
            body = [w.upper() + "!!" for w in body] if i % 8 else [w for w in body[:12] for _ in range(9)]
        rows.append((i, " ".join(body) + ".", ["en", "de", None][i % 3], f"s{i % 5}" if i % 2 else "hot"))
        labels.append((i, good, 0))
    return rows, labels


def test_documents(spark):
    rows, labels = corpus()
    rows += [(900, None, None, None), (901, "", "en", "hot"), (None, rows[1][1], "en", "hot"), (1, rows[1][1], "de", "s1")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, score string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = qc.score(docs, marks).collect()
    assert len(got) == len(rows) and all(0 < r.score < 1 and r.kept == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r.kept for r in got}
    assert sum(by_id[i] == bool(q) for i, q, _ in labels) >= 0.97 * len(labels)
    kept = qc.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_a_document_is_no_evidence_for_its_own_site(spark, monkeypatch):
    """The only document of a host has the global mean for a site, whatever its own evidence."""
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (700, rows[4][1], "xx", "lone"), (701, rows[5][1], "xx", "lone too")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in qc.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert abs(got[700].evidence - got[701].evidence) > 0.5
    mean = sum(r.evidence for r in got.values()) / len(got)
    assert got[700].site_mean == pytest.approx(mean) == pytest.approx(got[701].site_mean)


def test_columns_of_any_name_and_long_texts(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows] + [(500, "word and other " * 40_000, "en", "s", 7, 8)], "doc_id long, text string, lang string, source string, _row_key int, logit int")
    kept = qc.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {(r._row_key, r.logit) for r in kept.collect()} == {(7, 8)}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "one text", "en", "s")], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in qc.score(docs, none).collect()] == [True]
    assert qc.score(docs.limit(0), none).count() == 0 and qc.keep_good(docs.limit(0), none).count() == 0
