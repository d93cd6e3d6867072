"""Ordered-group operators, joins in time, assertions, sources and streams on small rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectio.functions import text as tx
from lectio.operators import compliance, decisions, integrity, joins, sampling, sequence
from lectio.registry import PARTS
from lectio.sources import external, files, lectures


def test_silences(spark):
    speech = spark.createDataFrame([("l", 1.0, 5.0), ("l", 2.0, 3.0), ("l", 6.0, 8.0)], "lecture string, start double, end double")
    durations = spark.createDataFrame([("l", 9.0)], "lecture string, duration double")
    assert sorted((r.start, r.end) for r in sequence.gaps_between(speech, "lecture", durations).collect()) == [(0, 1), (5, 6), (8, 9)]


def test_keyframe_times(spark):
    df = spark.createDataFrame([(95.0, [12.4, 47.9])], "d double, s array<double>")
    assert df.select(sequence.keyframe_times(F.col("d"), F.col("s")).alias("t")).first().t == [0, 12.4, 30, 47.9, 60, 90]


def test_as_of_and_pause(spark):
    gaps = spark.createDataFrame([("l", 2.0, 4.0), ("l", 40.0, 42.0)], "lecture string, start double, end double")
    events = spark.createDataFrame([("l", 1, 1.9), ("l", 2, 20.0), ("l", 3, 30.0)], "lecture string, id int, t double")
    got = {r.id: r.gap_start for r in joins.as_of_forward(events, gaps, "lecture", ["id"], "t").collect()}
    assert got == {1: 2.0, 2: None, 3: 40.0}
    short = spark.createDataFrame([("l", 1.0, 1.5), ("l", 2.0, 2.5), ("l", 3.0, 3.5)], "lecture string, start double, end double")
    assert joins.longest_pause(events.where("id = 1"), short, "lecture", ["id"], "t").first().pause_after == 0.5


def test_words_and_next_event(spark):
    words = spark.createDataFrame([("l", 94.0, "no"), ("l", 96.0, "inside"), ("l", 107.9, "also"), ("l", 108.0, "no")], "lecture string, start double, text string")
    spans = spark.createDataFrame([("l", 1, 100.0)], "lecture string, id int, t double")
    assert joins.words_between(words, spans, "lecture", ["id"], F.col("t") - 5, F.col("t") + 8).first().transcript_window == "inside also"
    rows = spark.createDataFrame([("a", 100.0), ("a", 120.0), ("b", 100.0), ("b", 900.0)], "lecture string, t double")
    got = {(r.lecture, r.t): (r.low, r.high) for r in sequence.next_event_span(rows, "lecture", "t").collect()}
    assert got["a", 100.0] == (95, 120) and got["b", 100.0] == (95, 145)


def test_nearest(spark):
    left = spark.createDataFrame([("l", 1, 10.0), ("l", 2, 50.0), ("m", 3, 1.0)], "k string, id int, t double")
    right = spark.createDataFrame([("l", 8.0, "x"), ("l", 12.0, "y")], "k string, time double, text string")
    got = {r.id: r.nearest_text for r in joins.nearest(left, right, "k", ["id"], "t", "time", "text", 8.0).collect()}
    assert got == {1: "x", 2: None, 3: None}


def test_novelty(spark):
    rows = spark.createDataFrame([("l", 1.0, "a b"), ("l", 2.0, "a b"), ("l", 3.0, "a c"), ("m", 1.0, "a b"), ("l", 4.0, "")], "lecture string, t double, text string")
    got = {(r.lecture, r.t): round(r.novelty, 6) for r in sequence.within_lecture_novelty(rows, "lecture", ["t"], "text").collect()}
    assert got == {("l", 1.0): 1, ("l", 2.0): 0, ("l", 3.0): 0.666667, ("m", 1.0): 1, ("l", 4.0): 1}


def test_unfilled_rows_stay(spark):
    rows = spark.createDataFrame([("m1", "None", "slide", "Cells", None, 3.0, None), ("m2", "Cells divide", "slide", "Cells", None, 3.0, False)], "moment_id string, ad_text string, type string, slide_ocr string, what_on_screen string, pause_after double, renders_cursor boolean")
    scored = {r.moment_id: r for r in compliance.score(rows).collect()}
    assert scored["m1"].overall is None and scored["m1"].reason == "unfilled"
    assert scored["m2"].deixis is None and scored["m2"].terminology == 0.5
    integrity.require_deixis_reason(compliance.score(rows))
    assert tx.STOP_TERMS[0] == "the"


def test_decisions(spark):
    answers = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (2, 1, "a"), (3, 0, "b"), (3, 1, "b"), (4, 0, "a"), (4, 1, "b"), (5, 0, "tie")], "moment_id int, order int, choice string")
    found = decisions.win_rate(decisions.outcomes(answers)).first()
    assert (found.won, found.lost, found.undecided) == (2, 1, 2) and abs(found.win_rate - 2 / 3) < 1e-12


def test_assertions(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(integrity.ContractError, match="not unique"):
        integrity.require_unique(df, "k")
    integrity.require_unique(df, "v")
    integrity.require_disjoint(df.where("k = 1"), df.where("k = 2"), "k")
    with pytest.raises(integrity.ContractError):
        integrity.require_disjoint(df, df, "k")
    with pytest.raises(integrity.ContractError, match="1 rater names"):
        integrity.require_pseudonyms(spark.createDataFrame([("R1",), ("Anna",)], "rater string"), "rater")
    with pytest.raises(ValueError):
        sampling.draw_keys(df, "k", 9, 1)


def test_field_map_and_manifest(spark):
    rows = spark.createDataFrame([("x1", "c", "7.5", "kept")], "id string, course string, start string, own string")
    got = lectures.FieldMap.parse(["moment_id=id", "lecture=course", "time=start"]).canonical(rows).first()
    assert (got.moment_id, got.lecture, got.t, got.own) == ("x1", "c", 7.5, "kept")
    with pytest.raises(integrity.ContractError):
        lectures.FieldMap.parse(["nothing=x"])
    bad = spark.createDataFrame([("l", "train", "maybe")], "lecture_id string, split string, renders_cursor string")
    with pytest.raises(Exception, match="not a flag"):
        lectures.manifest(bad).collect()
    with pytest.raises(integrity.ContractError):
        lectures.Catalogue("/data", {"a": "../x"})


def test_files(spark, tmp_path):
    path = f"{tmp_path}/rows"
    assert files.write_jsonl(spark.range(3), path) == 3
    assert files.read_jsonl(spark, path, "id long").count() == 3
    with pytest.raises(FileExistsError):
        files.write_jsonl(spark.range(1), path)
    files.write_json(spark, {"b": 1, "a": [2]}, f"{tmp_path}/one.json")
    assert json.loads((tmp_path / "one.json").read_text()) == {"a": [2], "b": 1}
    assert files.run_digest({"a": 1, "b": 2}) == files.run_digest({"b": 2, "a": 1})


def test_judge_runs_and_resumes(spark):
    items = spark.createDataFrame([("i1", "p1"), ("i2", "p2"), ("i3", "boom")], "item_id string, prompt string").repartition(3)
    done = spark.createDataFrame([("i1", None)], "item_id string, error string")

    def ask(prompts):
        if "boom" in prompts:
            raise RuntimeError("insufficient_quota")
        return ["Description 2." for _ in prompts]

    from lectio.functions.replies import parse_choice

    answers = external.run_judge(items, done, ask, parse_choice)
    got = {r.item_id: (r.answer, bool(r.error)) for r in answers.collect()}
    assert "i1" not in got and got["i3"] == (None, True)
    assert external.run_summary(answers).first().asked == 2
    with pytest.raises(PermissionError):
        external.require_approval(3.0, False)


def test_registry():
    assert "holm" in PARTS.names("multiple-test correction")
    part = PARTS.create("sequence factor", {"name": "novelty_knee", "params": {"knee": 0.5}})
    assert callable(part)
    with pytest.raises(ValueError):
        PARTS.create("sequence factor", {"name": "novelty_knee", "params": {"knie": 1}})
