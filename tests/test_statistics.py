"""Published values of the statistics kernels."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lectio.functions import statistics as st


@pytest.mark.parametrize("rule,expected", [("inclusive", (2, 96)), ("upper", (2, 97)), ("symmetric", (2, 96))])
def test_positions(rule, expected):
    assert st.percentile_positions(100, 0.95, rule) == expected


def test_positions_of_two_thousand():
    assert [st.percentile_positions(2000, 0.95, r) for r in ("inclusive", "upper", "symmetric")] == [(49, 1949), (50, 1950), (50, 1949)]


def test_exact_tests():
    assert st.exact_two_sided(0, 0) == st.exact_two_sided(5, 10) == 1
    assert st.exact_two_sided(10, 10) == 2 * 0.5**10
    assert abs(st.mcnemar(66, 59) - 0.59) < 0.01
    assert st.mcnemar(58, 8) < 1e-4


def test_wilson_and_holm():
    assert [round(x, 4) for x in st.wilson(7, 10)] == [0.7, 0.3968, 0.8922]
    found = st.holm({"a": 0.01, "b": 0.04, "c": 0.03})
    assert {k: (round(p, 9), r) for k, (p, r) in found.items()} == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}


def test_krippendorff():
    pairs = {("a", "a"): 4, ("b", "b"): 10, ("a", "b"): 3, ("b", "a"): 3}
    n, a, b = 20, 7, 13
    assert abs(st.krippendorff(pairs) - (1 - (6 / n) / (2 * a * b / (n * (n - 1))))) < 1e-12
    assert st.krippendorff({("a", "a"): 4}) == 1.0


def test_cluster_bootstrap_is_the_pooled_resample(spark):
    data = {"lec-a": [1, 2, 3], "lec-b": [7, 8], "lec-c": [4]}
    rows = [(c, float(v), i) for i, (c, v) in enumerate((c, v) for c, vs in data.items() for v in vs)]
    df = spark.createDataFrame(rows, "cluster string, value double, o int")
    mean, low, high = st.cluster_bootstrap_mean(df, "cluster", "value", "o", 500, 3)
    rng = random.Random(3)
    names = list(data)
    values = sorted(np.mean([v for _ in names for v in data[names[rng.randrange(3)]]]) for _ in range(500))
    assert abs(mean - 25 / 6) < 1e-12
    at = st.percentile_positions(500)
    assert (low, high) == pytest.approx((values[at[0]], values[at[1]]))
    assert st.cluster_bootstrap_mean(df.where("cluster = 'lec-c'"), "cluster", "value", "o") == (4.0, None, None)


def test_power():
    assert st.detectable_agreement(0) is None and 0.5 < st.detectable_agreement(100) < 0.65
    share, points = st.detectable_difference(40, 200)
    assert st.power_of(40, share)[0] >= 0.8 > st.power_of(40, share - 1e-6)[0] and abs(points - 100 * (2 * share - 1) * 40 / 200) < 1e-9


def test_exact_tests_and_power_of_many_trials():
    n = 20_000
    tail = sum(math.comb(n, i) for i in range(101))
    assert st.exact_two_sided(100, n) == pytest.approx(2 * tail / 2**n, abs=0)
    term, total = math.comb(1200, 560), 0
    for i in range(560, -1, -1):
        total, term = total + term, term * i // (1200 - i + 1)
    assert st.exact_two_sided(560, 1200) == pytest.approx(2 * total / 2**1200, rel=1e-11)
    share, points = st.detectable_difference(5_000_000, 20_000_000)
    assert 0.5 < share < 0.501 and abs(st.power_of(5_000_000, share)[0] - 0.8) < 1e-6 and points == pytest.approx(50 * (share - 0.5))
    assert st.exact_two_sided(2_497_000, 5_000_000) == pytest.approx(math.erfc(2999.5 / math.sqrt(2_500_000)), rel=1e-3)


def test_ridge_fit_finds_the_signs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x @ [2.0, -1.0] + rng.normal(size=400) > 0).astype(float)
    w = st.logistic_weights(x, np.ones(400), y)
    assert w[0] > 0.5 > -0.3 > w[1]


def test_spearman():
    assert st.spearman([1, 2, 3], [3, 2, 1]) == -1 and st.spearman([1, 1], [1, 2]) is None
    rho, low, high = st.spearman_with_interval(range(12), [x + (x % 3) for x in range(12)], 200)
    assert low <= rho <= high and math.isclose(rho, st.spearman(range(12), [x + (x % 3) for x in range(12)]))
