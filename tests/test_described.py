"""What has been described so far: the cases of the definition, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectio.operators import sequence

KIND = "lecture string, writer string, t double, text string, slide string, emit boolean"


def told(spark, texts, window=sequence.DESCRIBED_WINDOW):
    rows = [("lec-a", "w", float(k), *x, *([True] if len(x) == 2 else [])) for k, x in enumerate(texts)]
    found = sequence.described_so_far(spark.createDataFrame(rows, KIND), "lecture", "writer", ["t"], "text", "slide", "emit", window)
    return found.withColumn("prompt", sequence.described_text()).orderBy("t").collect()


def test_starts_empty_and_keeps_what_the_slide_shows(spark):
    got = told(spark, [("Folded cristae fill the mitochondrion.", "Mitochondrion cristae matrix"), ("A beautiful folded cristae structure.", "Mitochondrion cristae"), ("x", "")])
    assert got[0].prompt == sequence.NOTHING_DESCRIBED and got[0].described == []
    assert got[0].new_elements == ["cristae", "mitochondrion"] and got[1].new_elements == []
    assert got[2].prompt == "cristae; mitochondrion" and got[2].elements_so_far == 2


def test_without_a_slide_every_term_counts(spark):
    got = told(spark, [("Folded cristae appear.", ""), ("Cristae again.", None)])
    assert got[0].new_elements == ["Folded", "cristae", "appear"] and got[1].new_elements == ["again"]


def test_structural_and_short_words_are_no_elements(spark):
    got = told(spark, [("The figure shows a table and a chart.", "figure table chart cristae"), ("The ion and the axon.", "ion axon"), ("The figure shows mitochondria on the left slide", "")])
    assert [r.new_elements for r in got] == [[], ["axon"], ["shows", "mitochondria"]]


def test_only_the_most_recent_are_carried(spark):
    slide = "alpha beta gamma"
    got = told(spark, [("alpha", slide), ("beta", slide), ("gamma", slide), ("more", slide)], window=2)
    assert got[3].described == ["beta", "gamma"] and got[3].elements_so_far == 3


def test_silence_and_blank_texts_add_nothing(spark):
    got = told(spark, [(None, "cristae"), ("  ", "cristae"), ("The cristae fold.", "cristae", False), ("The cristae fold.", "cristae", None), ("Cristae fold.", "   ")])
    assert [r.new_elements for r in got] == [[]] * 5 and got[4].prompt == sequence.NOTHING_DESCRIBED


def test_only_forty_terms_of_a_description_and_eighty_of_a_slide(spark):
    names = [f"term{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(100)]
    got = told(spark, [(" ".join(names), ""), (" ".join(names[40:60] + names[78:82]), " ".join(names))])
    assert got[0].new_elements == names[:40] and got[1].new_elements == names[40:60] + names[78:80]


def test_lectures_and_writers_are_apart_and_the_first_spelling_stays(spark):
    rows = [(a, w, t, text, "", True) for a in "ab" for w in "xy" for t, text in ((1.0, f"Cristae {a}{w}word"), (2.0, "cristae matrix"))]
    got = sequence.described_so_far(spark.createDataFrame(rows, KIND), "lecture", "writer", ["t"], "text", "slide", "emit").where("t = 2")
    assert {(r.lecture, r.writer): r.described for r in got.collect()} == {(a, w): ["Cristae", f"{a}{w}word"] for a in "ab" for w in "xy"}
    assert got.select(F.size("new_elements").alias("n")).distinct().collect()[0].n == 1
