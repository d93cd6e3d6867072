"""Registered queries against their SQL, on the smallest tables, where they are there."""

from __future__ import annotations

import itertools
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lectio.functions.overlap import chrf_score
from lectio.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables are not here")
    connection = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def plain(frame: pd.DataFrame) -> list:
    def one(v):
        if not isinstance(v, str) and pd.isna(v):
            return ""
        return str(v) if isinstance(v, str | bool) or type(v).__name__ == "bool" else f"{float(v):.5f}"

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, tables, name):
    own = catalogue.QUERIES[name](spark, DATA).toPandas()
    other = tables.execute(catalogue.SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert plain(own) == plain(other)


def test_every_query_says_what_it_covers():
    assert catalogue.FLAGSHIP in catalogue.QUERIES and set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert all(f.__doc__ for f in catalogue.QUERIES.values())


def test_entry_imports_without_the_training_data_subpackage():
    code = """
import sys
class Without:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("lectio.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Without())
import __spark_entry__ as e
assert len(e.queries()) > 60 and "pipeline" not in e.queries() and "score_systems" in e.oracle_sql()
"""
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": str(root)})


def test_build_pairs_ranks_by_chrf(spark, tmp_path):
    texts = ["the derivative is the slope", "green cats sleep all morning", "the derivative is the slope", "the derivative is a slope of the tangent line"]
    rows = [(m, turn, "ab"[turn % 2], text + " again" * m) for m in (1, 2) for turn, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    expected = set()
    for m in (1, 2):
        ranked = []
        for (_, i, v, a), (_, j, w, b) in itertools.combinations([r for r in rows if r[0] == m], 2):
            distance = 100 - 50 * (chrf_score(a, b) + chrf_score(b, a))
            ranked += [(v == w, -distance, i, j, a, b)] * (distance >= 12)
        used, kept = Counter(), 0
        for _, distance, i, j, a, b in sorted(ranked):
            if kept < 4 and used[a] < 2 and used[b] < 2:
                used.update((a, b))
                kept += 1
                expected.add((m, i, j, round(-distance, 4)))
    got = {(r.moment_id, r.a_ordinal, r.b_ordinal, r.distance) for r in catalogue.QUERIES["build_pairs"](spark, str(tmp_path)).collect()}
    assert got == expected and len(got) > 3


def test_pairs_of_a_moment_are_compared_at_once(spark):
    from lectio.functions.overlap import chrf_within
    from lectio.operators import decisions

    texts = ["the slope of a curve", None, "", "a curve has a slope", "the slope of a curve", "x"]
    rows = spark.createDataFrame([("m", k, t, "ab"[k % 2]) for k, t in enumerate(texts)] + [("alone", 0, "one", "a")], "moment string, o int, t string, w string")
    got = {(r.a_ordinal, r.b_ordinal): r for r in decisions.compared_pairs(rows, "moment", "o", "t", "w", chrf_within).collect()}
    assert sorted(got) == list(itertools.combinations(range(6), 2))
    for (i, j), r in got.items():
        assert (r.a, r.b, r.forward, r.backward) == (texts[i], texts[j], chrf_score(texts[i], texts[j]), chrf_score(texts[j], texts[i]))


def test_pair_violations_of_equal_and_empty_sides(spark, tmp_path):
    texts = ["one two three"] * 2 + ["", "one two three four"] + ["", "one"] + [None, "one two three four five"] + ["a b c d e f", "a"] + ["same", "same"] + [" ", ""] + ["x", "x y z w v"]
    rows = [(i + 1, text, "en", "s", len(text or "")) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    own = catalogue.QUERIES["pair_violations"](spark, str(tmp_path)).toPandas()
    assert plain(own) == plain(connection.execute(catalogue.SQL["pair_violations"]).df()) and len(own) == 8


def test_keyframe_times_take_every_user_and_error(spark, tables):
    got = {r.lecture: [float(x) for x in r.times.split(",")] for r in catalogue.QUERIES["keyframe_times"](spark, DATA).collect()}
    line = "epoch_us(ts - TIMESTAMP '2024-01-01' + TIMESTAMP '1970-01-01') // 1000000"
    expected = {}
    for user, scenes, last in tables.execute(f"SELECT user_id, list({line}) FILTER (event_type = 'error'), max({line}) FROM events GROUP BY 1").fetchall():
        kept = []
        for x in sorted({*(scenes or []), *range(0, int(last) + 1, 3000)}):
            if not kept or x - kept[-1] >= 500:
                kept.append(x)
        expected[user] = kept
    assert got == expected
