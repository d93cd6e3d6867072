"""Published input and output pairs of the scalar functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectio.functions import ids, replies, scoring, times
from lectio.functions import text as tx
from lectio.functions.overlap import chrf_score


@pytest.fixture(scope="module")
def value(spark):
    def get(column):
        return spark.range(1).select(column.alias("v")).first().v

    return get


def test_text(value):
    assert value(tx.clean_description(F.lit(" [Before]  A graph. "))) == "A graph."
    assert value(tx.word_count(F.lit("[after] one two\n three"))) == 3
    assert value(tx.is_sentinel(F.lit(" (No Speech) "))) is True
    assert value(tx.strip_sentinels(F.lit("a (no speech in this window) b"))) == "a   b"
    assert value(tx.content_terms(F.lit("The Cell and the cell wall, for x-ray"))) == ["Cell", "wall", "x-ray"]
    assert value(tx.content_terms(F.lit("aa bbb ccc ddd"), 2)) == ["bbb", "ccc"]
    assert value(tx.following_terms(F.lit("it is one two-three 44 four"), 2)) == "one two-three"
    assert sorted(value(tx.token_set(F.lit("A a B2")))) == ["a", "b2"]
    assert value(tx.slide_title(F.lit("Cells: a start. More\nnext"))) == "Cells"
    assert value(tx.slide_title(F.lit(" "))) is None
    assert value(tx.quote_is_grounded(F.lit("big ... CAT"), F.lit("The big\n black cat"))) is True
    assert value(tx.quote_is_grounded(F.lit("cat ... big"), F.lit("the big black cat"))) is False
    assert value(tx.is_unfilled(F.lit(" None "))) is True
    assert value(tx.says_something(F.lit("..."))) is False
    assert [value(tx.is_pseudonym(F.lit(x))) for x in ("R1", "rater_12", "Anna")] == [True, True, False]


@pytest.mark.parametrize("sentence", ["You see a cell.", "The line was red.", "A circle is drawn.", "A beautiful graph.", "The slide shows a cell."])
def test_one_property_costs_half(value, sentence):
    assert value(scoring.style_score(F.lit(sentence))) == 0.5


def test_style_leaves_quotes_and_states_alone(value):
    assert value(scoring.style_score(F.lit('Text reads "you were great".'))) == 1.0
    assert value(scoring.style_score(F.lit("The axis is labeled 2024."))) == 1.0
    assert value(scoring.style_score(F.lit(" "))) == 0.0


def test_components(value):
    assert value(scoring.terminology_score(F.lit("Mitochondrion chloroplast"), F.lit("Mitochondrion cristae matrix"))) == 0.5
    assert value(scoring.terminology_score(F.lit("It is an ox."), F.lit(""))) == 1.0
    words = F.lit(" ".join(["word"] * 80))
    assert value(scoring.length_score(words, F.lit(0.0), 120.0)) == 0.5
    assert value(scoring.length_score(words, F.lit(10.0), 120.0)) == 0.75
    pointing = F.lit("This mitochondrion is large, and that thing is small.")
    assert value(scoring.deixis_score(pointing, F.lit("mitochondrion"))) == 0.5
    assert value(scoring.deixis_score(F.lit("The cursor moves."), F.lit("cell"))) == 0.0


def test_scores(value):
    assert [round(value(scoring.credit_for_similarity(F.lit(x))), 9) for x in (0.0, 0.17, 0.585, 1.0, 1.2)] == [1, 1, 0.5, 0, 0]
    assert [round(value(scoring.novelty_factor(F.lit(x))), 9) for x in (1.0, 0.4, 0.2, 0.0, 0.39)] == [1, 1, 0.5, 0, 0.975]
    assert [value(scoring.reachable_rung(F.lit(p), scoring.RUNG_WORDS)) for p in (11.0, 7.0, 0.0, -1.0)] == [1, 2, 3, 3]
    assert [value(scoring.reachable_rung(F.lit(p), 25)) for p in (0.0, 4.0, 8.0, 11.0)] == [3, 3, 3, 1]
    assert tuple(value(scoring.band_for(F.lit("uncovered"), F.lit(3), F.lit(0.0)))) == ("XL", 40, 46)
    assert tuple(value(scoring.band_for(F.lit("uncovered"), F.lit(3), F.lit(20.0)))) == ("XL", 40, 60)
    assert value(scoring.band_for(F.lit("UNCOVERED"), F.lit(4), F.lit(9.0))).band == "S"
    assert round(value(scoring.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))), 6) == 0.707107
    assert (chrf_score("same text", "same text"), chrf_score("abc", "xyz")) == (1.0, 0.0)


def test_times(value):
    assert value(times.clock_to_seconds(F.lit("1:02:03.5"))) == 3723.5
    assert value(times.clock_to_seconds(F.lit("0:60:00"))) == -1
    assert value(times.minutes_to_seconds(F.lit("75:30"))) == 4530
    assert value(times.packed_to_seconds(F.lit("010203.jpg"))) == 3723
    assert value(times.packed_to_seconds(F.lit("notes.txt"))) is None
    assert [value(times.as_seconds(F.lit(x))) for x in ("12.5", "0:00:10", "", "-3", "true")] == [12.5, 10, -1, -1, -1]
    assert value(times.seconds_to_clock(F.lit(3723.9))) == "01:02:03"
    assert value(times.seconds_to_packed(F.lit(59.0))) == "000059"


def test_ids(value):
    assert value(ids.moment_id(F.lit("lec-a"), F.lit(17))) == "lec-a#0017"
    assert value(ids.moment_id(F.lit("lec-a"), F.lit(7), True)) == "lec-a#g007"
    assert value(ids.moment_of(F.lit("lec-a#0017::w"))) == "lec-a#0017"
    assert (value(ids.writer_of(F.lit("m::w::x"))), value(ids.writer_of(F.lit("m")))) == ("w::x", None)
    assert value(ids.lecture_of(F.lit("lec-a#0017"))) == "lec-a"
    assert [value(ids.is_gap_moment(F.lit(x))) for x in ("l#g001", "l#0001")] == [True, False]
    with pytest.raises(Exception, match="no moment id"):
        value(ids.moment_id(F.lit("a#b"), F.lit(1)))


@pytest.mark.parametrize("reply,choice", [("1", "1"), ("Between 1 and 2, I choose 2.", None), ("Description 2.", "2"), ("It is a tie between them.", "tie"), ("quantities", None), ("", None)])
def test_choice(value, reply, choice):
    assert value(replies.parse_choice(F.lit(reply))) == choice


@pytest.mark.parametrize("reply,rating", [("4 out of 5", 4), ("3/5", 3), ("2 on a scale from 1 to 5", 2), ("3 or 4", None), ("none", None)])
def test_scale(value, reply, rating):
    assert value(replies.parse_scale(F.lit(reply), 1, 5)) == rating


def test_json_replies(value):
    assert value(replies.extract_json(F.lit('see {"a": "}"} or [1]'))) == '{"a": "}"}'
    assert value(replies.parse_verdict(F.lit('```json\n{"verdict": "pass"}\n```'))) == "PASS"
    assert value(replies.salvage(F.lit('{"ad_text": "half a'))).how == "open_string"
    assert tuple(value(replies.parse_rubric(F.lit("style: 4/5\noverall: 9\nstyle: 3"), ["style"]))) == (3, 9)


def test_style_counts_equal_the_bare_patterns(spark):
    """The words that a pattern needs leave no match out, in any case and with letters that case folding joins."""
    rng = random.Random(6)
    pieces = "You your YOURSELF was Were had it appeared is shown are quickly drawn being listed been erased beautiful Beautifully lovely clear elegant well-made easy to read hard to see the slide shows this image now depicts what appears here as we can see one can notice is visible on the slide an image of the presenter this slide , . - ' \" _ your_s iſ waſ K ı hıd ſlide".split(" ")
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["an image of", "Is visible on the screen", "what is displayed here", "here you see", "WE CAN OBSERVE", "the ſlide ſhows", "had", "a_was", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = {name: sum(F.regexp_count(F.regexp_replace(F.coalesce("t", F.lit("")), '"[^"]{0,200}"', " "), F.lit(f"(?iU){p}")) for p in patterns) for name, patterns in tx.STYLE.items()}
    got = rows.select("t", *(v.alias(k) for k, v in tx.style_violations("t").items()), *(v.alias(f"bare_{k}") for k, v in bare.items())).collect()
    assert all(r[k] == r[f"bare_{k}"] for r in got for k in bare)
    assert all(any(r[k] for r in got) for k in bare)
