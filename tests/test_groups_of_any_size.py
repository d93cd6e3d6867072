"""Operators that spread a hot group, against slow versions."""

from __future__ import annotations

import random
import statistics as plain
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from lectio.functions import statistics
from lectio.functions import text as tx
from lectio.operators import decisions, sequence


def rows_of(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1.0, float(rng.randint(-5, 5)), rng.random() * 1e6, -rng.random()])) for _ in range(n)]


@pytest.mark.parametrize(("bins", "settled"), [(256, 4096), (4, 3), (2, 1)])
def test_quantiles_by_refinement(spark, monkeypatch, bins, settled):
    monkeypatch.setattr(statistics, "BINS", bins)
    monkeypatch.setattr(statistics, "SETTLED", settled)
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"least": (0, 1), "third": (1, 3), "high": (99, 100), "most": (1, 1)}
    groups = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows}}
    expected = {(g, name): vs[max(1, -(-len(vs) * p // q)) - 1] for g, vs in groups.items() for name, (p, q) in shares.items()}
    assert {(r.g, r.name): r.quantile for r in statistics.exact_quantiles(df, ["g"], "v", shares).collect()} == expected
    assert {r.g: r.median for r in statistics.medians(df, ["g"], "v").collect()} == {g: pytest.approx(plain.median(vs)) for g, vs in groups.items()}


def test_spearman_with_ties_and_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, *range(6)]), rng.randint(0, 9)) for g in ["hot"] * 200 + ["b"] * 9 + [None] * 5] + [("flat", 1, k) for k in range(4)]
    got = {r.g: (r.rho, r.n) for r in statistics.spearman_frame(spark.createDataFrame(rows, "g string, a int, b int"), "a", "b", ["g"]).collect()}
    for g in ("hot", "b", None, "flat"):
        both = [(a, b) for h, a, b in rows if h == g and a is not None]
        rho = statistics.spearman(*zip(*both, strict=True))
        assert got[g][1] == len(both) and (got[g][0] is None) == (rho is None) and (rho is None or got[g][0] == pytest.approx(rho))


def test_ranks_put_rows_without_a_value_last(spark):
    rows = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 3.0), ("w", None)], "s string, v double")
    assert {r.s: r.position for r in sequence.ranks(rows, [], "v", "s").collect()} == {"y": 1, "z": 2, "x": 3, "w": 4}


def test_draws_down_the_tree_are_multinomial():
    sizes = np.array([10, 0, 30, 60, 20])
    draws = np.array([statistics._path_draws(sizes, b, 4000, 7) for b in range(len(sizes))])
    assert (draws.sum(0) == sizes.sum()).all() and not draws[1].any()
    share = sizes / sizes.sum()
    assert np.abs(draws.mean(1) - sizes).max() < 0.6
    assert np.allclose(draws.var(1), sizes.sum() * share * (1 - share), rtol=0.12)
    assert np.cov(draws[2], draws[3])[0, 1] == pytest.approx(-sizes.sum() * share[2] * share[3], rel=0.2)


def test_unit_bootstrap(spark):
    values = [random.Random(k).gauss(5, 2) for k in range(900)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(-1, None)], "u long, v double").repartition(5)
    for units in (65_536, 100):
        mean, low, high = statistics.unit_bootstrap_mean(df, "u", "v", 400, 3, bucket_units=units)
        se = plain.pstdev(values) / 30
        assert mean == pytest.approx(plain.fmean(values)) and low < mean < high and high - low == pytest.approx(2 * 1.96 * se, rel=0.2)
        assert statistics.unit_bootstrap_mean(df.repartition(2), "u", "v", 400, 3, bucket_units=units) == (pytest.approx(mean), pytest.approx(low), pytest.approx(high))
    assert statistics.unit_bootstrap_mean(df.where("u < 0"), "u", "v") == (None, None, None) and statistics.unit_bootstrap_mean(df.where("u = 3"), "u", "v")[1:] == (None, None)


def test_the_interval_covers_the_mean():
    rng = np.random.default_rng(1)
    covered = 0
    for k in range(300):
        values = rng.exponential(1.0, 120)
        sizes = np.array([40, 40, 40])
        sums = sum(statistics.resampled_sums(values[b * 40 : b * 40 + 40], statistics._path_draws(sizes, b, 200, k), k, b) for b in range(3)) / 120
        low, high = statistics.percentile_positions(200)
        covered += np.sort(sums)[low] <= 1.0 <= np.sort(sums)[high]
    assert 0.88 * 300 <= covered <= 0.98 * 300


def test_rater_report_and_measure(spark):
    rng = random.Random(4)
    pairs = [(f"p{k}", rng.choice(["style", "", None]), rng.choice([decisions.ORDER_SENSITIVE, "natural", None])) for k in range(40)]
    labels = [(r, p[0], rng.choice(["a", "b", "tie"])) for p in pairs for r in ("R1", "R2")]
    scores = [(p[0], s, rng.choice([1.0, 2.0, None]), rng.choice([1.0, 2.0])) for p in pairs for s in ("x", "y") if rng.random() < 0.8]
    got = decisions.rater_report(spark.createDataFrame(labels, "rater string, pair_id string, side string"), spark.createDataFrame(scores, "pair_id string, scorer string, a double, b double"), spark.createDataFrame(pairs, "pair_id string, axis string, stratum string"))
    expected: dict = {}
    known = {p: (axis or "natural", stratum == decisions.ORDER_SENSITIVE) for p, axis, stratum in pairs}
    for rater, pair, side in labels:
        for p, scorer, a, b in scores:
            if p == pair and side != "tie":
                axis, sensitive = known[p]
                for key in [(rater, scorer, "order_sensitive", None)] if sensitive else [(rater, scorer, "overall", None), (rater, scorer, "by_group", axis)]:
                    cell = expected.setdefault(key, [0, 0, 0])
                    if a is not None and a == b:
                        cell[2] += 1
                    elif a is not None:
                        cell[0] += 1
                        cell[1] += ("a" if a > b else "b") == side
    assert {(r.rater, r.scorer, r.part, r.group): [r.n, r.agreed, r.metric_ties] for r in got.collect()} == expected
    verdicts = [(rng.choice("gh"), *rng.choice([(True, "x"), (False, "y"), (True, "y"), (None, None)])) for _ in range(50)]
    measured = {r.g: r for r in decisions.measure(spark.createDataFrame(verdicts, "g string, right boolean, by string"), ["g"]).collect()}
    for g in "gh":
        own = [v for v in verdicts if v[0] == g]
        r = measured[g]
        assert (r.pairs, r.decided, r.ties, r.n_right) == (len(own), sum(v[1] is not None for v in own), sum(v[1] is None for v in own), sum(v[1] is True for v in own))
        assert r.decided_by == dict(Counter(v[2] for v in own if v[2]))
    whole = decisions.measure(spark.createDataFrame([], "right boolean, by string")).first()
    assert (whole.pairs, whole.ties, whole.coverage, whole.decided_by) == (0, 0, None, {})


@pytest.mark.parametrize("rare", [1, 3, 64])
def test_novelty_of_long_lectures(spark, rare):
    rng = random.Random(rare)
    words = [f"w{k}" for k in range(30)] + ["the", "of"]
    rows = [(lecture, float(t), " ".join({rng.choice(words[: rng.choice([6, 32])]) for _ in range(rng.randint(0, 7))} | ({"the"} if rng.random() < 0.8 else set()))) for lecture in ("long", "longer") for t in range(40 if lecture == "long" else 70)] + [("short", float(t), "the w1") for t in range(5)]
    got = sequence.within_lecture_novelty(spark.createDataFrame(rows, "lecture string, t double, text string"), "lecture", ["t"], "text", block=10, rare=rare)
    expected = {}
    for lecture, t, text in rows:
        own = set(text.split())
        earlier = [set(x.split()) for g, s, x in rows if g == lecture and s < t]
        expected[lecture, t] = round(1 - max((len(own & e) / len(own | e) for e in earlier if own and e), default=0.0), 9)
    assert {(r.lecture, r.t): round(r.novelty, 9) for r in got.collect()} == expected


def test_features_that_raters_pull_apart_are_dropped(spark):
    rng = random.Random(9)
    pairs, labels = [], []
    for k in range(60):
        a, b = ({f: rng.random() for f in ("same", "torn", "base")} for _ in range(2))
        pairs.append((f"p{k}", "g", a, b))
        for rater, sign in (("R1", 1), ("R2", -1)):
            pull = 3 * (a["same"] - b["same"]) + sign * 3 * (a["torn"] - b["torn"]) + sign * (a["base"] - b["base"])
            labels.append((rater, f"p{k}", "a" if pull > 0 else "b"))
    labels.append(("R3", "p0", "tie"))
    frames = spark.createDataFrame(pairs, "pair_id string, `group` string, a map<string,double>, b map<string,double>"), spark.createDataFrame(labels, "rater string, pair_id string, side string")
    assert statistics.sign_stable(*frames, ["same", "torn", "base"]) == (["same"], ["torn", "base"])
    assert statistics.sign_stable(*frames, ["same", "torn", "base"], keep=("base",)) == (["same", "base"], ["torn"])


def test_a_moment_with_too_many_candidates_is_refused(spark):
    rows = spark.createDataFrame([("m", k, f"t{k}", "w") for k in range(5)], "moment string, ordinal int, text string, writer string")
    assert decisions.candidate_pairs(rows, "moment", "ordinal", "text", "writer").count() == 10
    with pytest.raises(Exception, match="more than 4 candidates"):
        decisions.candidate_pairs(rows, "moment", "ordinal", "text", "writer", most=4).collect()


def test_novelty_of_short_lectures_is_compared_as_arrays(spark, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "", "eps"]
    rows = [(f"l{k}", float(t), " ".join(rng.choices(words, k=rng.randrange(4)))) for k in range(12) for t in range(1 + 3 * k)]
    frame = spark.createDataFrame(rows, "lecture string, t double, text string")
    found = lambda **how: {(r.lecture, r.t): r.novelty for r in sequence.within_lecture_novelty(frame, "lecture", ["t"], "text", **how).collect()}
    in_tasks = found(short=0)
    monkeypatch.setattr(sequence, "_most_overlap", None)
    assert found(short=40) == in_tasks and len(in_tasks) == len(rows)


def test_style_of_a_text_is_counted_once_and_white_space_is_unicode(spark):
    rows = [("\u2003\x0b The slide shows you a clear image, which was neat. \u00a0\n",), ('"you were" is quoted',), ("",), (None,), ("\u200bNone",), ("\u3000None\x85",)]
    frame = spark.createDataFrame(rows, "s string")
    old = F.regexp_replace(F.coalesce("s", F.lit("")), r"(?U)^\s+|\s+$", "")
    got = frame.select(F.struct(*(v.alias(k) for k, v in tx.style_violations("s").items())).alias("v"), tx.clean_description("s").alias("clean"), old.alias("old"), tx.is_unfilled("s").alias("gone")).collect()
    assert got[0].v.second_person == 1 and got[0].v.meta_reference > 0 and got[1].v.second_person == got[1].v.past_tense == 0
    assert all(r.clean == r.old for r in got) and [r.gone for r in got] == [False, False, True, True, False, True]
