"""Streams: state, restarts and the same rows as the batch forms."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from lectio.operators import sequence
from lectio.streaming import live


def landed(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:03}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_the_log_survives_a_kill_between_write_and_commit(spark, tmp_path):
    schema = "id string, answer string, error string"
    landed(tmp_path / "in", 0, [{"id": "a", "answer": "1"}, {"id": "b", "error": "timeout"}, {"id": "a", "answer": "1"}])
    landed(tmp_path / "in", 1, [{"id": "b", "answer": "2"}, {"id": "a", "answer": "9"}, {"id": "c", "error": "refused"}])
    landed(tmp_path / "in", 2, [{"id": "d", "answer": "4"}, {"id": "c", "error": "refused"}])

    def die(epoch):
        if epoch == 1:
            raise RuntimeError("killed before the commit")

    def run(after_write=None):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        return live.append_answers(stream, str(tmp_path / "log"), str(tmp_path / "checkpoint"), "id", after_write)

    with pytest.raises(Exception, match="killed"):
        run(die).awaitTermination(90)
    landed(tmp_path / "in", 3, [{"id": "b", "answer": "5"}])
    run().awaitTermination(90)
    kept = live.logged_answers(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema).collect()
    fine = sorted((r.id, r.answer) for r in kept if not r.error)
    assert fine == [("a", "1"), ("b", "2"), ("d", "4")]
    assert {r.id for r in kept if r.error} == {"b", "c"}


def test_described_stream_gives_the_batch_rows(spark, tmp_path):
    rng = random.Random(3)
    words = ["cristae", "matrix", "Membrane", "axon", "ion", "figure", "Neuron", "cell", "and", "vesicle"]
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(60):
        text, slide = (" ".join(rng.choices(words, k=5)) if rng.random() < 0.9 else None for _ in range(2))
        rows.append({"lecture": f"l{k % 2}", "writer": "w", "at": (start + datetime.timedelta(minutes=k)).isoformat(), "id": f"{k:03}", "text": text, "slide": slide if k % 3 else "", "emit": k % 5 != 0})
    schema = "lecture string, writer string, at timestamp, id string, text string, slide string, emit boolean"
    shuffled = [r for at in range(0, 60, 12) for r in rng.sample(rows[at : at + 12], 12)]
    for number in range(5):
        landed(tmp_path / "in", number, shuffled[number * 12 : number * 12 + 12])

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        found = live.described_stream(stream, "20 minutes")
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)

    run()
    last = [{"lecture": f"l{k}", "writer": "w", "at": (start + datetime.timedelta(days=9)).isoformat(), "id": "end", "text": None, "slide": None, "emit": False} for k in range(2)]
    landed(tmp_path / "in", 9, last)
    run()
    landed(tmp_path / "in", 10, [dict(r, at=(start + datetime.timedelta(days=20)).isoformat(), id="later") for r in last])
    run()
    got = {r.id: (r.described, r.new_elements, r.elements_so_far) for r in spark.read.parquet(str(tmp_path / "out")).where("id < 'a'").collect()}
    frame = spark.read.schema(schema).json(str(tmp_path / "in")).where("id < 'a'").withColumn("ms", F.unix_millis("at"))
    batch = sequence.described_so_far(frame, "lecture", "writer", ["ms", "id"], "text", "slide", "emit")
    expected = {r.id: ("; ".join(r.described), ",".join(r.new_elements), r.elements_so_far) for r in batch.collect()}
    assert got == expected and len(got) == 60


def test_novelty_stream_over_restarts(spark, tmp_path):
    rows = [("l", float(k), " ".join(random.Random(k).choices("abcdefgh", k=4)) + " every") for k in range(12)] + [("m", 1.0, ""), ("m", 2.0, "x")]
    schema = "lecture string, at double, text string"
    for number, part in enumerate((rows[:5], rows[5:9], rows[9:])):
        landed(tmp_path / "in", number, [dict(zip(("lecture", "at", "text"), r, strict=True)) for r in part])
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        found = live.streaming_novelty(stream, "lecture", "at", "text")
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.lecture, r["at"]): round(r.novelty, 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = sequence.within_lecture_novelty(spark.createDataFrame(rows, schema), "lecture", ["at"], "text")
    assert got == {(r.lecture, r["at"]): round(r.novelty, 9) for r in batch.collect()}
