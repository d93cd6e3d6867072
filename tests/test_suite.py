"""The evaluation suite, channels as table functions, and open rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectio.operators import channels, compliance, suite
from lectio.sources import files

MOMENT = "moment_id string, lecture string, t double, type string, slide_ocr string, what_on_screen string, transcript_window string, pause_after double, renders_cursor boolean"


def moments_of(spark):
    return spark.createDataFrame([(f"m{k}", "l", float(k), "slide" if k % 2 else "figure", "Cells divide quickly", None, "", 5.0, None) for k in range(4)], MOMENT)


def test_evaluate_runs_what_its_inputs_allow(spark, tmp_path):
    said = spark.createDataFrame([("m0", "x", "Cells divide"), ("m1", "x", "Cells divide"), ("m2", "x", "None"), ("m0", "y", "You see a wonderful cell")], "moment_id string, system string, ad_text string")
    found = suite.evaluate({"predictions": said, "moments": moments_of(spark), "references": said}, compliance.rule_table(spark), str(tmp_path))
    assert sorted(found.tables) == ["rank_stability", "reference_writers", "rules_broken", "summary", "systems"]
    assert found.left_out["rater_agreement"] == "nothing was given for pairs, labels, scores" and set(found.left_out) | set(found.tables) == set(suite.TABLES)
    systems = {r.system: (r.n_scored, r.n_moments, r.position) for r in found.tables["systems"].collect()}
    assert {s: n[:2] for s, n in systems.items()} == {"x": (2, 4), "y": (1, 4)} and {n[2] for n in systems.values()} == {1, 2}
    assert {r.system: (r.n_scored, r.n_moments) for r in found.tables["reference_writers"].collect()} == {"x": (2, 2), "y": (1, 1)}
    whole = found.tables["summary"].where("stratum IS NULL").first()
    assert (whole.n_total, whole.n_scored, whole.n_unfilled, whole.n_missing, whole.n_moments) == (8, 3, 1, 4, 4)
    assert whole.style_n + whole.style_abstained == whole.n_scored
    kept = spark.read.parquet(f"{tmp_path}/scored")
    assert kept.count() == 8 and set(compliance.SEQUENCE_RULES) <= set(kept.where("key = 'm1::x'").first().broken)
    assert {r.rule: r.broken_by for r in found.tables["rules_broken"].collect()}[compliance.SEQUENCE_RULES[0]] == 1
    with pytest.raises(ValueError, match="no inputs called"):
        suite.evaluate({"predicted": said}, compliance.rule_table(spark))


def test_pixel_motion_from_sql_and_by_name(spark):
    pictures = [(0, False), (255, False), (255, True), (250, False), (0, False)]
    rows = spark.createDataFrame([("l", float(k), claimed, 5.0, bytes([grey] * 4)) for k, (grey, claimed) in enumerate(pictures)] + [("m", 0.0, False, 5.0, bytes(4)), ("m", 1.0, False, 40.0, bytes([255] * 4)), ("m", 2.0, False, 5.0, bytes([255] * 4))], "lecture string, time double, claimed boolean, apart double, picture binary")
    expected = {("l", 0.0): None, ("l", 1.0): 1.0, ("l", 2.0): None, ("l", 3.0): None, ("l", 4.0): round(250 / 255, 9), ("m", 0.0): None, ("m", 1.0): None, ("m", 2.0): None}
    plain = lambda df: {(r.lecture, r.time): r.motion and round(r.motion, 9) for r in df.collect()}
    assert plain(channels.pixel_motion(rows, "lecture")) == expected
    channels.register(spark)
    rows.createOrReplaceTempView("frames_of_lectures")
    assert plain(spark.sql("SELECT * FROM pixel_motion(TABLE(frames_of_lectures) PARTITION BY (lecture) ORDER BY (time), 0.02D, 30D)")) == expected


def test_open_rows_keep_undeclared_fields(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id": "a", "n": 3, "more": {"x": [1, 2]}, "flag": true}\n\n{"id": "b", "n": "many"}\n')
    rows = files.read_open(spark, f"{tmp_path}/rows.jsonl", "id string, n int")
    got = {r.id: r for r in rows.select("id", "n", F.map_keys("rest").alias("keys"), F.try_variant_get(F.col("rest")["more"], "$.x[1]", "int").alias("x")).collect()}
    assert (got["a"].n, sorted(got["a"]["keys"]), got["a"].x) == (3, ["flag", "more"], 2)
    assert got["b"].n is None and got["b"]["keys"] == []
    (tmp_path / "bad.jsonl").write_text('{"id": "a"\n')
    with pytest.raises(Exception, match="(?i)malformed|parse|json"):
        files.read_open(spark, f"{tmp_path}/bad.jsonl", "id string").collect()
