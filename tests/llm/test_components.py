"""Union-find on small edge tables, which one task takes whole, and on shuffled ones."""

from __future__ import annotations

import random

from lectio.llm import components


def test_small_tables_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    expected = sorted((x, find(x)) for x in linked)
    edges = spark.createDataFrame(pairs, "u long, v long")
    plans = []
    original = components.written

    def traced(df, label, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, label, **more)

    monkeypatch.setattr(components, "written", traced)
    for most in (components.ONE_TASK, 0):
        monkeypatch.setattr(components, "ONE_TASK", most)
        plans.clear()
        assert sorted(map(tuple, components.connected_components(edges).collect())) == expected
        assert len(plans) > 4
        assert any("Exchange hashpartitioning" in p for p in plans[1:]) == (most == 0)
