"""Rows around a model call, probes, the rule book, interfaces and the registry, on small rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.functions import replies, statistics
from lectio.operators import compliance, moments, probes, sampling, sequence, standard
from lectio.registry import PARTS
from lectio.sources import external


def test_predicates(spark):
    rows = spark.createDataFrame([("pointing", "one two three", 2, True, "p"), ("slide", " ", 9, False, None), (None, None, None, None, "p")], "kind string, text string, rung int, said boolean, path string")
    got = rows.select(
        moments.axes_for("kind").alias("axes"),
        moments.usable_candidate("text", "rung", F.lit(2), F.lit(5)).alias("usable"),
        moments.scorable("said", F.array("kind"), "path").alias("scorable"),
        moments.allowed_types(F.array(F.lit("slide"), F.lit("pointing")), F.coalesce("said", F.lit(False))).alias("types"),
    ).collect()
    assert [len(r.axes) for r in got] == [6, 5, 5]
    assert [r.usable for r in got] == [True, False, False] and [r.scorable for r in got] == [True, False, False]
    assert [len(r.types) for r in got] == [2, 1, 1]


def test_strict_context_fails_on_unmatched_and_repeated(spark):
    contexts = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    assert {r.key: r.x for r in moments.with_context(frame("ab"), contexts, "key").collect()} == {"a": 1, "b": 2}
    for keys, message in (("ac", "has no context"), ("aa", "more than once")):
        with pytest.raises(Exception, match=message):
            moments.with_context(frame(keys), contexts, "key").collect()


def test_batches(spark):
    wanted = spark.createDataFrame([(b, i) for b in "wxyz" for i in range(3)], "batch string, id int")
    got = spark.createDataFrame([("w", 0), ("w", 1), ("w", 2), ("x", 0), ("x", 0), ("x", 1), ("y", 0), ("y", 1), ("y", 7)], "batch string, id int")
    assert {r.batch: r.fault for r in moments.batch_faults(wanted, got).collect()} == {"w": None, "x": "repeated", "y": "missing", "z": "count"}
    rows = spark.createDataFrame([("b", 2, "e2", "gap", "x"), ("b", 1, "e1", "slide", None)], "batch string, n int, id string, channel string, transcript string")
    text = moments.request_lines(rows, "batch", "n").first().request
    assert text.split("\n")[1:3] == ["- id: e1 | detector channel: slide | transcript: ", "- id: e2 | detector channel: gap | transcript: x"] and text.endswith("exactly 2 JSON objects, one per candidate, in this order.")


def test_to_moments(spark):
    answers = spark.createDataFrame([("a", "slide", "01:05", " s "), ("b", "reject", "00:01", None), ("c", "chart", "later", None)], "id string, type string, stated string, what_on_screen string")
    candidates = spark.createDataFrame([(k, "l", 7.0) for k in "abc"], "id string, lecture string, t double")
    got = {r.id: (r.t, r.type, r.what_on_screen) for r in moments.to_moments(answers, candidates).collect()}
    assert got == {"a": (65.0, "slide", "s"), "c": (7.0, "chart", "")}
    wrong = spark.createDataFrame([("a", "poem", "01:05", "s")], answers.schema)
    with pytest.raises(Exception, match="outside the closed set"):
        moments.to_moments(wrong, candidates).collect()


def test_settings():
    assert moments.layered({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    assert moments.resolve_settings({"root": "${DATA}/x", "n": [1, "${DATA}"]}, {"DATA": "d"}) == {"root": "d/x", "n": [1, "d"]}
    for bad in ({"root": "/abs"}, {"root": "${UNSET}"}, {"other": 1}):
        with pytest.raises(ValueError):
            moments.resolve_settings(bad, {}, {"root"})


def test_cell_deltas_and_probe(spark):
    rng = np.random.default_rng(1)
    first, second = (rng.integers(0, 256, (40, 50), dtype=np.uint8) for _ in range(2))
    got = probes.cell_deltas(first.tobytes(), second.tobytes(), 50)
    assert got.shape == (2, 3)
    assert got[1, 2] == pytest.approx(np.abs(first[16:32, 32:48].astype(int) - second[16:32, 32:48]).mean())
    assert probes.covered_cells(64, 32, (10, 0, 33, 16)) == [0, 1, 2]
    still, moved = np.zeros((32, 32), np.uint8), np.zeros((32, 32), np.uint8)
    moved[20:30, 2:12] = 255
    clock = [still.copy() for _ in range(4)]
    for k, frame in enumerate(clock):
        frame[:16, 16:] = 200 * (k % 2)  # cell 1 changes in every pair
    frames = [("l", k, (f | (moved if k == 2 else still)).tobytes()) for k, f in enumerate(clock)]
    deltas = probes.frame_deltas(spark.createDataFrame(frames, "lecture string, n int, picture binary"), "lecture", "n", "picture", 32)
    masked = probes.layout_cells(deltas, "lecture", share=0.9)
    assert [(r.lecture, r["cell"]) for r in masked.collect()] == [("l", 1)]
    found = probes.probe(deltas, masked, "lecture", ["lecture"], "n").first()
    assert (found.hot_cells, found.pairs, found.at_cell) == (1, 3, 2) and found.peak_delta == pytest.approx(255 * 100 / 256)


def test_rule_tables(spark):
    table = compliance.rule_table(spark)
    assert table.count() == 45 and [r.number for r in table.orderBy("number").collect()] == list(range(1, 46))
    reached = {r.rule for r in compliance.reached_rules(table).collect()}
    out = {r.rule for r in compliance.unreached_rules(table).collect()}
    assert len(reached | out) == 45 and not reached & out and "figure_002" in out and "cross_cutting_006" in reached
    book = [{"id": r[0], "tag": "DOC", "route": r[6], "text": "t"} for r in compliance.RULES]
    assert standard.table_faults(table, standard.rule_book(spark, book)).count() == 0
    book[3]["route"] = "penalty" if book[3]["route"] != "penalty" else "judge"
    got = {(r.rule, r.fault) for r in standard.table_faults(table.where("number != 5"), standard.rule_book(spark, book)).collect()}
    assert (book[3]["id"], "routes differ") in got and (compliance.RULES[4][0], "only in the book") in got
    assert (compliance.RULES[44][0], "numbers aren't 1 to n") in got


def test_novelty_by_blocks_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(sequence, "NOVELTY_ROWS", 7)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randrange(1000)) + k / 1000, " ".join(["same", *rng.choices("c d e f g h i j k".split(), k=rng.randint(0, 6))]), k % 9 != 0) for k in range(90)]
    frame = spark.createDataFrame(rows, "lecture string, t double, text string, used boolean")
    got = {(r.lecture, r.t): r.novelty for r in sequence.within_lecture_novelty(frame, "lecture", ["t"], "text", F.col("used")).collect()}
    assert len(got) == 90
    for lecture, t, text, used in rows:
        own = set(text.split())
        before = [set(x.split()) for le, at, x, u in rows if u and le == lecture and at < t]
        expected = 1 - max((len(own & e) / len(own | e) for e in before), default=0.0) if used else None
        assert got[lecture, t] == (pytest.approx(expected) if used else None)


def test_heads(spark):
    rng = random.Random(3)
    pairs, labels = [], []
    for k in range(240):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        pairs.append((f"p{k}", f"g{k % 3}", {"x": x, "y": y}, {"x": 0.0, "y": 0.0}))
        for rater in ("R1", "R2"):
            side = "a" if 2 * x - y + rng.gauss(0, 0.5) > 0 else "b"
            labels.append((f"p{k}", rater, "tie" if rng.random() < 0.1 else side))
    pair_frame = spark.createDataFrame([*pairs, ("q", "g0", {"x": 1.0}, {"x": 0.0})], "pair_id string, group string, a map<string,double>, b map<string,double>")
    label_frame = spark.createDataFrame([*labels, ("q", "R1", "a")], "pair_id string, rater string, side string")
    rows = statistics.head_rows(pair_frame, label_frame, ["x", "y"])
    assert rows.where("pair_id = 'q'").isEmpty() and rows.agg(F.sum("weight")).first()[0] == sum(s != "tie" for _, _, s in labels)
    weights = statistics.fit_folds(rows, ["x", "y"], "chose_a", "weight", "group")
    local = [r for r in rows.collect() if r.group != "g1"]
    plain = statistics.logistic_weights(np.array([[r.x, r.y] for r in local]), np.array([r.weight for r in local]), np.array([r.chose_a for r in local]))
    assert weights["g1"][:-1] == pytest.approx(plain, abs=1e-6)
    frozen = statistics.freeze(pair_frame, label_frame, ["x", "y"], "R2")
    assert frozen[0] > 1 > 0 > frozen[1]
    scored = statistics.score_frozen(frozen, pair_frame, label_frame.where("rater = 'R2'"), ["x", "y"]).first()
    assert scored.agreement > 0.8 and scored.low < scored.agreement < scored.high
    with pytest.raises(ValueError, match="collinear"):
        statistics.solve(np.ones((2, 2)), np.ones(2))
    with pytest.raises(ValueError, match="rater"):
        statistics.freeze(pair_frame, label_frame, ["x", "y"], "R9")


def test_power_from_the_definition():
    from math import comb

    for n, share in ((12, 0.7), (41, 0.62)):
        p_value = lambda k, n=n: min(1.0, 2 * min(sum(comb(n, i) for i in range(k + 1)), sum(comb(n, i) for i in range(k, n + 1))) / 2**n)
        expected = sum(comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1) if p_value(k) <= 0.05)
        assert statistics.power_of(n, share)[0] == pytest.approx(expected)
    assert statistics.detectable_difference(3, 10) == (None, None) == statistics.detectable_difference(0, 10)


def test_largest_json_goes_on_after_a_failure():
    for text, expected in (("Well {sic}: {\"k\":1} [1]", '{"k":1}'), ("[" * 5000, None), ('{"a": {"b": 1}, c}', '{"b": 1}'), ('"{" {"b":[1,2]}', '{"b":[1,2]}'), (None, None)):
        assert replies._largest_json(text) == expected


def test_salvage_steps(spark):
    rows = spark.createDataFrame([('{"ad_text": "x"}',), ('so: {"ad_text": "x"}',), ('{"ad_text": "x',), ("no",), (None,)], "r string")
    wanted = {"strict_object": ["x", None, None, None, None], "balanced_object": ["x", "x", None, None, None]}
    for step, expected in wanted.items():
        assert [r.t for r in rows.select(PARTS.create("salvage step", step)("r").alias("t")).collect()] == expected
    assert PARTS.create("salvage step", "open_string") is not None


def test_registry_has_every_family():
    assert len(PARTS.families) == 31 and all(PARTS.families.values())
    assert PARTS.names("controlled axis") == tuple(sorted(moments.AXES)) and len(PARTS.names("judge")) == 7


def test_interfaces(spark):
    media = spark.createDataFrame([("a.mp4",), ("broken",)], "path string")

    def run(path):
        if path == "broken":
            raise OSError("no such file")
        return {"duration": 1250.0, "audio": True}

    got = {r.path: (r.duration, r.error) for r in external.probe_media(media, run).collect()}
    assert got == {"a.mp4": (1250.0, None), "broken": (None, "no such file")}
    lengths = spark.createDataFrame([("l", 1250.0)], "lecture string, duration double")
    assert [(r.start, r.end) for r in external.cut_times(lengths, "lecture").orderBy("chunk").collect()] == [(0, 600), (600, 1200), (1200, 1250)]
    boxes = spark.createDataFrame([("l", 1.0, 2, "b", 0.5), ("l", 1.0, 1, "a", 0.9), ("l", 2.0, 1, "z", 0.1)], "lecture string, time double, place int, text string, confidence double")
    assert {r.time: r.text for r in external.slide_text(boxes, "lecture", least=0.4).collect()} == {1.0: "a b", 2.0: ""}
    calls = []
    ask = external.asker(lambda body: calls.append(body) or "ok", model="m", system="s")
    assert ask(["p", "q"]) == ["ok", "ok"] and calls[0]["messages"][1]["content"][-1]["text"] == "p"

    def fails(body):
        calls.append(body)
        raise RuntimeError("Error code: 401 - invalid_api_key")

    calls.clear()
    with pytest.raises(RuntimeError):
        external.asker(fails, model="m", system="s")(["p"])
    assert len(calls) == 1
    items = spark.createDataFrame([("x", "even"), ("y", "odd")], "item_id string, prompt string")
    generate = lambda prompts, t: ["1" if p == "even" or t > 0 else "?" for p in prompts]
    decoded = {r.item_id: r.attempt for r in external.decode(items, generate, (0.0, 0.7), replies.parse_choice).collect()}
    assert decoded == {"x": 0, "y": 1}
    assert external.markdown(items.orderBy("item_id")).split("\n")[2] == "| x | even |"
    told = spark.createDataFrame([("l", 2, "b"), ("l", 1, "a")], "lecture string, n int, x string")
    written = external.write_lecture(told, "lecture", "n", lambda row, said: {"n": row["n"], "ad_text": "+".join([*said, row["x"]])}, "n long, ad_text string")
    assert {r.n: r.ad_text for r in written.collect()} == {1: "a", 2: "a+b"}


def test_first_per_group_bounds_what_is_drawn(spark):
    keys = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    got = sampling.first_per_group(keys, ["g"], "k", 5, 1)
    assert got.count() == 15 and {tuple(r) for r in got.collect()} == {tuple(r) for r in sampling.first_per_group(keys.repartition(7), ["g"], "k", 5, 1).collect()}


def test_offered_types_are_read_back_from_the_two_blank_layout(spark):
    prompt = "Choose.\nTYPES - use exactly one:\n  slide    the slide\n  figure  a figure\n song  one blank less\n  poem one blank after\n\n  chart   after the list"
    assert spark.range(1).select(moments.offered_types(F.lit(prompt)).alias("o")).first().o == ["slide", "figure"]


def test_a_prompt_that_offers_too_few_is_refused(spark):
    got = spark.createDataFrame([("x", "slide"), ("x", "poem"), ("y", "slide"), ("z", None)], "batch string, type string")
    offered = lambda n: F.array(*map(F.lit, ("slide", "figure", "chart", "table", "reject")[:n]))
    assert {r.batch: (r.fault, r.labels) for r in moments.vocabulary_faults(got, offered(5)).collect()} == {"x": ("outside", "poem"), "z": ("outside", "None")}
    assert {r.batch: r.fault for r in moments.vocabulary_faults(got, offered(4)).collect()} == {"x": "few", "y": "few", "z": "few"}

def test_strict_checks_are_not_pruned_away(spark):
    frame = lambda keys, column: spark.createDataFrame([(k, 1) for k in keys], f"key string, {column} int")
    for predicted, known in (("ab", "a"), ("aa", "a"), ("a", "aa")):
        joined = moments.with_context(frame(predicted, "v"), frame(known, "c"), "key")
        for read in (lambda: joined.count(), lambda: joined.select("v").collect(), lambda: joined.select("v", "c").collect()):
            with pytest.raises(Exception, match="context|predicted"):
                read()
    manifest = spark.createDataFrame([("a", "train")], "lecture_id string, split string")
    sided = sampling.side_of(frame("ab", "v"), manifest, "key")
    for read in (sided.count, sided.select("v").collect):
        with pytest.raises(Exception, match="no split"):
            read()


def test_answers_with_other_pass_and_unknown_labels_fail(spark):
    candidates = spark.createDataFrame([(k, "l", 5.0) for k in "abc"], "id string, lecture string, t double")
    answers = lambda *labels: spark.createDataFrame([(k, label, "01:10", "x ") for k, label in zip("abc", labels, strict=False)], "id string, type string, stated string, what_on_screen string")
    found = moments.to_moments(answers("other", "reject", "slide"), candidates)
    assert {(r.id, r.type, r.t) for r in found.collect()} == {("a", "other", 70.0), ("c", "slide", 70.0)}
    for label in ("poem", None):
        with pytest.raises(Exception, match="closed set"):
            moments.to_moments(answers("slide", label), candidates).select("lecture").collect()


def test_contracts(spark):
    rows = spark.createDataFrame([("a", "", "fig", {"q": "one two", "c": "X"}), ("b", "x", "poem", {"q": "two ... four", "c": "A", "r": "1"}), ("c", "x", None, {"q": "", "r": ""})], "key string, said string, kind string, reply map<string,string>")
    found = moments.input_faults(rows, "key", {"said": {"non_empty": True}, "kind": {"allowed": ("fig",)}, "gone": {}})
    assert {r.key: r.faults for r in found.collect()} == {"a": ["said: empty", "gone: missing"], "b": ["kind: poem isn't allowed", "gone: missing"], "c": ["gone: missing"]}
    out = moments.output_faults(rows.withColumn("said", F.lit("One  two three\nfour")), "key", "reply", ("r",), {"q": "said"}, {"c": ("A",)})
    assert {r.key: r.faults for r in out.collect()} == {"a": ["missing r", "c outside its set: X"]}


def test_times_come_from_the_first_row(spark):
    rows = spark.createDataFrame([("m", 2, "00:00:09", None), ("m", 1, None, "7.5"), ("n", 1, "soon", "3"), ("", 1, "5", "5")], "m string, o int, time string, t string")
    assert {r.m: r.seconds for r in moments.times_of(rows, "m", "o").collect()} == {"m": 7.5, "n": 0.0}


def test_terminal_conditions_by_name(spark):
    errors = {"Error code: 402 - pay": "OUT OF CREDIT", "x insufficient_quota": "OUT OF CREDIT", "Error code: 403": "AUTHENTICATION REJECTED", "invalid_api_key": "AUTHENTICATION REJECTED", "429 RESOURCE_EXHAUSTED": "QUOTA EXHAUSTED", "moment 401#0402 not found": None, "billing": None, None: None}
    rows = spark.createDataFrame([(e,) for e in errors], "e string")
    assert {r.e: r.c for r in rows.select("e", external.terminal_condition("e").alias("c")).collect()} == errors
    asked = []
    ask = external.asker(lambda body: asked.append(1) or (_ for _ in ()).throw(RuntimeError("Error code: 401")), model="m", system="s", tries=3)
    with pytest.raises(RuntimeError):
        ask(["x"])
    assert len(asked) == 1


def test_lists_of_scored_rows(spark):
    kind = "moment_id string, ad_text string, type string, slide_ocr string, what_on_screen string, pause_after double, renders_cursor boolean, lecture string, t double, transcript_window string"
    rows = [("m1", "None", "slide", "Cells", None, 3.0, None, "l", 1.0, ""), ("m2", "You can see cells divide", "slide", "Atoms", None, 3.0, False, "l", 2.0, ""), ("m3", "You can see cells divide", "figure", "cells divide", None, 3.0, True, "l", 3.0, ""), ("m4", "x", "slide", "", None, 3.0, None, "l", 4.0, "")]
    whole = spark.createDataFrame(rows, kind)
    found = compliance.score_predictions(whole.where("moment_id != 'm4'").select("moment_id", "ad_text"), whole.drop("ad_text"), compliance.rule_table(spark), "moment_id", "lecture", ["t"])
    got = {r.moment_id: r for r in found.collect()}
    everything = list(compliance.scoring.CATEGORIES)
    assert (got["m1"].reason, got["m1"].abstained, got["m1"].broken) == ("unfilled", everything, [])
    assert (got["m4"].reason, got["m4"].abstained, got["m4"].short) == ("missing", everything, [])
    assert got["m2"].abstained == ["deixis", "faithfulness", "non_redundancy"] and got["m3"].abstained == ["faithfulness", "non_redundancy"]
    rule_checks = {r[0]: r[7].split(";") for r in compliance.RULES}
    style = [r for r, checks in rule_checks.items() if set(checks) & set(compliance.CHECKS["style_properties"])]
    assert set(got["m2"].broken) & set(style) and set(got["m2"].broken) <= set(rule_checks)
    assert got["m2"].short and not set(got["m2"].short) & set(style)
    assert got["m3"].broken[-2:] == list(compliance.SEQUENCE_RULES) and not set(got["m2"].broken) & set(compliance.SEQUENCE_RULES)


def test_described_so_far_keeps_the_last_terms(spark):
    rows = [("l", "w", float(k), f"Cell{k} Nucleus Membrane{k % 3}") for k in range(6)]
    frame = spark.createDataFrame(rows, "lecture string, writer string, t double, text string")
    got = [r.described for r in sequence.described_so_far(frame, "lecture", "writer", ["t"], "text", window=4).orderBy("t").collect()]
    said: list[str] = []
    for k, terms in enumerate(got):
        assert terms == said[-4:]
        said += [w for w in (f"Cell{k}", "Nucleus", f"Membrane{k % 3}") if w not in said]
