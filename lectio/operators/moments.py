"""Rows around a model call: contexts, batches, answers, reference rows (PRJ-12 to PRJ-15, J-01, J-12, J-21, A-15, A-18, D-22 to D-28, S-40)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectio.functions import ids, replies, scoring, times
from lectio.functions import text as tx
from lectio.operators import joins

# Fixed values.
POINTING = "pointing"
REJECT = "reject"
COVERAGE = ("COVERED", "PARTIAL", "UNCOVERED")
RUNGS = (1, 2, 3, 4)
#: A prompt that offers fewer labels did not compose.
LEAST_OFFERED = 5
#: Axis: the moment types that it needs; none: any type.
AXES = {"style": (), "terminology": (), "length": (), "deixis": (POINTING,), "faithfulness": (), "non_redundancy": ()}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- predicates


def allowed_types(types, draws_pointer) -> Column:
    """PRJ-12: the labels that a recording can carry: no pointing where no pointer is drawn."""
    return F.filter(_col(types), lambda t: _col(draws_pointer) | (t != POINTING))


def scorable(described, references=None, image=None) -> Column:
    """PRJ-13: described, and with the references (an array) and the picture that a metric needs."""
    there = _col(described)
    if references is not None:
        there = there & (F.coalesce(F.size(_col(references)), F.lit(0)) > 0)
    if image is not None:
        there = there & _col(image).isNotNull()
    return F.coalesce(there, F.lit(False))


def usable_candidate(text, rung, low, high) -> Column:
    """PRJ-14: not blank, within the band of words, and at a rung that can be delivered."""
    words = tx.word_count(text)
    return F.coalesce((words > 0) & words.between(_col(low), _col(high)) & _col(rung).isin(*RUNGS), F.lit(False))


def axes_for(kind, names: tuple[str, ...] = tuple(AXES)) -> Column:
    """PRJ-15: the axes that can be built on a moment of this type, in the order of their names' list."""
    fits = [F.when(F.lit(not AXES[n]) | F.coalesce(_col(kind).isin(*AXES[n]), F.lit(False)), F.lit(n)) for n in names]
    return F.array_compact(F.array(*fits))


# ---------------------------------------------------------------- joins


def failing(rows: DataFrame, fault: Column) -> DataFrame:
    """The rows; one with a fault (a text) fails the query. The check is a filter, so that no choice of columns prunes it."""
    return rows.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))


def with_context(predictions: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """J-01: each prediction with its context; one without a context, a second one, or a second context fails the query."""
    once = Window.partitionBy(key)
    known = contexts.withColumn("_m", F.count("*").over(once))
    joined = predictions.withColumn("_n", F.count("*").over(once)).join(known, key, "left")
    named = F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    fault = F.when(F.col("_n") > 1, F.concat(named, F.lit(" is predicted more than once"))).when(F.col("_m").isNull(), F.concat(named, F.lit(" has no context"))).when(F.col("_m") > 1, F.concat(named, F.lit(" has more than one context")))
    return failing(joined, fault).drop("_n", "_m")


def image_at(frames: DataFrame, images: DataFrame, lecture: str, time: str = "time", image: str = "path") -> DataFrame:
    """J-12: the picture whose whole second is that of the frame; null where there is none."""
    keyed = images.select(lecture, F.col(time).cast("int").alias("_second"), image).groupBy(lecture, "_second").agg(F.min(image).alias(image))
    return frames.withColumn("_second", F.col(time).cast("int")).join(keyed, [lecture, "_second"], "left").drop("_second")


def with_facts(rows: DataFrame, *sources: DataFrame, key: str, fact: str) -> DataFrame:
    """J-21: ``fact`` from the first source that states it for the key; null where none does."""
    out, found = rows, []
    for k, source in enumerate(sources):
        found.append(F.col(f"_fact{k}"))
        out = out.join(source.groupBy(key).agg(F.first(fact, ignorenulls=True).alias(f"_fact{k}")), key, "left")
    return out.withColumn(fact, F.coalesce(*found)).drop(*(f"_fact{k}" for k in range(len(sources))))


def own_moments(moments: DataFrame, described: DataFrame, key: str = "moment_id") -> DataFrame:
    """PRJ-18: the moments that a writer described."""
    return moments.join(described.select(key), key, "left_semi")


# ---------------------------------------------------------------- summaries


def kept_per_rule(rows: DataFrame) -> DataFrame:
    """A-15: per rule the share of PASS among PASS and FAIL; rules without either are left out."""
    judged = rows.where(F.col("answer").isin("PASS", "FAIL"))
    return judged.groupBy("rule").agg(F.avg((F.col("answer") == "PASS").cast("double")).alias("share"), F.count("*").alias("n"))


def summarise_predictions(predictions: DataFrame, text: str = "ad_text", how: str = "how") -> DataFrame:
    """A-18: moments, described, empty, those that chose to describe, and how many were read in which way (``n=way`` in order)."""
    filled = ~tx.is_unfilled(text)
    per = predictions.groupBy(how).agg(F.count("*").alias("n"), F.count_if(filled).alias("f"), F.count_if("emit").alias("e"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(how).alias("how"), "n"))), lambda x: F.concat(x["how"], F.lit("="), x["n"].cast("string"))), ",")
    return per.agg(F.sum("n").alias("moments"), F.sum("f").alias("described"), (F.sum("n") - F.sum("f")).alias("empty"), F.sum("e").alias("chose_to_describe"), listed.alias("read_by"))


def complete_only(rows: DataFrame, moment: str, writer: str, writers: list[str]) -> tuple[DataFrame, DataFrame]:
    """A-24: the rows of moments that every writer answered, and (moment, missing) of those left out."""
    missing = joins.missing_writers(rows, moment, writer, writers)
    left_out = missing.where(F.size("missing") > 0)
    return rows.join(left_out.select(moment), moment, "left_anti"), left_out


# ---------------------------------------------------------------- batches and answers


def request_lines(candidates: DataFrame, batch: str, order: str) -> DataFrame:
    """V-10: per batch the text that names its candidates (id, channel, transcript), in order."""
    line = F.concat(F.lit("- id: "), F.col("id"), F.lit(" | detector channel: "), F.col("channel"), F.lit(" | transcript: "), F.coalesce("transcript", F.lit("")))
    rows = candidates.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["l"]), "\n")
    ask = F.concat(F.lit("Return exactly "), F.size("ls").cast("string"), F.lit(" JSON objects, one per candidate, in this order."))
    return rows.select(batch, F.concat(F.lit("CANDIDATES IN THIS BATCH:\n"), body, F.lit("\n\n"), ask).alias("request"))


def offered_types(prompt) -> Column:
    """V-10: the labels that a prompt offers, read back from the lines under TYPES: two blanks, the label, two blanks or more, up to an empty line."""
    block = F.regexp_extract(_col(prompt), r"(?m)^TYPES[^\n]*\n((?:[^\n]*\S[^\n]*(?:\n|\z))*)", 1)
    return F.array_distinct(F.regexp_extract_all(block, F.lit(r"(?m)^\s{2}([a-z_]+)\s{2,}"), F.lit(1)))


def batch_faults(wanted: DataFrame, got: DataFrame, batch: str = "batch", key: str = "id") -> DataFrame:
    """D-22: per batch its first fault: another number of answers, an id answered twice, an id without an answer; else null."""
    asked = wanted.groupBy(batch).agg(F.count("*").alias("n_asked"))
    answered = got.groupBy(batch).agg(F.count("*").alias("n_got"), F.count_distinct(key).alias("n_ids"))
    missing = wanted.join(got.select(batch, key), [batch, key], "left_anti").groupBy(batch).agg(F.count("*").alias("n_missing"))
    all_of = asked.join(answered, batch, "left").join(missing, batch, "left").fillna(0, ["n_got", "n_ids", "n_missing"])
    fault = F.when(F.col("n_asked") != F.col("n_got"), "count").when(F.col("n_ids") < F.col("n_got"), "repeated").when(F.col("n_missing") > 0, "missing")
    return all_of.select(batch, "n_asked", "n_got", "n_missing", fault.alias("fault"))


def vocabulary_faults(got: DataFrame, offered: Column, batch: str = "batch", label: str = "type") -> DataFrame:
    """D-22: (batch, fault, labels): few where the prompt offers under LEAST_OFFERED labels, else outside with the labels not offered, in order."""
    few = F.size(offered) < LEAST_OFFERED
    outside = F.when(~few & ~F.coalesce(F.array_contains(offered, F.col(label)), F.lit(False)), F.coalesce(F.col(label).cast("string"), F.lit("None")))
    per = got.groupBy(batch).agg(F.max(few).alias("_few"), F.array_join(F.array_sort(F.collect_set(outside)), ",").alias("labels"))
    return per.where("_few OR labels != ''").select(batch, F.when(F.col("_few"), "few").otherwise("outside").alias("fault"), "labels")


def to_moments(answers: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """D-23: accepted answers as moments: the stated time where it can be read, else the candidate's.

    A label outside the closed set fails the query; rejected candidates are left out.
    """
    known = F.coalesce(F.col("type").isin(*scoring.MOMENT_TYPES, REJECT), F.lit(False))
    checked = failing(answers, F.when(~known, F.concat(F.col(key).cast("string"), F.lit(": label "), F.coalesce(F.col("type"), F.lit("")), F.lit(" is outside the closed set"))))
    stated = times.minutes_to_seconds("stated")
    joined = checked.where(~F.col("type").eqNullSafe(REJECT)).join(candidates, key)
    return joined.select(key, "lecture", F.when(stated >= 0, stated).otherwise(F.col("t")).cast("double").alias("t"), "type", F.trim(F.coalesce("what_on_screen", F.lit(""))).alias("what_on_screen"))


# ---------------------------------------------------------------- prompt contracts


def input_faults(rows: DataFrame, key: str, inputs: dict[str, dict]) -> DataFrame:
    """D-24: (key, faults): the inputs of a call that break its contract; rows without a fault are left out.

    ``inputs`` names the inputs: {"non_empty": bool, "allowed": tuple of texts}. A column that isn't there is missing in every row.
    """
    found = []
    for name, spec in inputs.items():
        if name not in rows.columns:
            found.append(F.lit(f"{name}: missing"))
            continue
        body = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        if spec.get("non_empty", False):
            found.append(F.when(body == "", F.lit(f"{name}: empty")))
        if spec.get("allowed"):
            found.append(F.when((body != "") & ~body.isin(*spec["allowed"]), F.concat(F.lit(f"{name}: "), body, F.lit(" isn't allowed"))))
    return rows.select(key, F.array_compact(F.array(*found)).alias("faults")).where(F.size("faults") > 0)


def output_faults(rows: DataFrame, key: str, reply: str, required: tuple[str, ...] = (), quotes: dict[str, str] | None = None, closed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """D-24: (key, faults): how a parsed reply (a map of texts) breaks its contract, in the contract's order; rows without a fault are left out.

    ``quotes``: reply field: the column of which it must be a verbatim span; ``closed``: reply field: what it may be.
    """
    value = lambda name: F.col(reply)[name]
    found = [F.when(~F.map_contains_key(reply, name), F.lit(f"missing {name}")) for name in required]
    for name, source in (quotes or {}).items():
        there = F.coalesce(value(name), F.lit("")) != ""
        grounded = F.coalesce(tx.quote_is_grounded(value(name), source), F.lit(False))
        found.append(F.when(there & ~grounded, F.lit(f"{name} is no span of {source}")))
    for name, allowed in (closed or {}).items():
        found.append(F.when(value(name).isNotNull() & ~value(name).isin(*allowed), F.concat(F.lit(f"{name} outside its set: "), value(name))))
    return rows.select(key, F.array_compact(F.array(*found)).alias("faults")).where(F.size("faults") > 0)


def times_of(rows: DataFrame, moment: str, ordinal: str, time: str = "time", t: str = "t") -> DataFrame:
    """V-03: (moment, seconds) from the first row of each moment; 0 where its time can't be read."""
    first = rows.where(F.coalesce(F.col(moment), F.lit("")) != "").groupBy(moment).agg(F.min_by(F.coalesce(F.col(time).cast("string"), F.col(t).cast("string")), ordinal).alias("_t"))
    seconds = times.as_seconds("_t")
    return first.select(moment, F.when(seconds >= 0, seconds).otherwise(0.0).cast("double").alias("seconds"))


# ---------------------------------------------------------------- contexts and rows


def writer_contexts(moments: DataFrame, words: DataFrame, slides: DataFrame, gaps: DataFrame, lecture: str, before: float, after: float, skew: float, horizon: float, policy=scoring.RUNG_WORDS) -> DataFrame:
    """D-25: per moment the fields of a prompt: transcript_window, slide_ocr, pause_after, reachable_rung.

    moments: (lecture, moment_id, t, ...); words: (lecture, start, text); slides: (lecture, time, text); gaps: (lecture, start, end).
    """
    spoken = joins.words_between(words, moments, lecture, ["moment_id"], F.col("t") - before, F.col("t") + after, before + after)
    shown = joins.nearest(spoken, slides.select(lecture, "time", F.col("text").alias("slide")), lecture, ["moment_id"], "t", "time", "slide", skew)
    paused = joins.longest_pause(shown, gaps, lecture, ["moment_id"], "t", horizon)
    return paused.withColumn("slide_ocr", F.coalesce("nearest_slide", F.lit(""))).withColumn("reachable_rung", scoring.reachable_rung(F.col("pause_after"), policy))


def package_text(kind, said, ocr, screen, pause, with_screen: bool) -> Column:
    """S-40: a moment as the lines that a describer is given; the text arm names what is on screen, the picture arm doesn't."""
    clean = lambda c: F.trim(F.coalesce(_col(c), F.lit("")))
    lines = [F.concat(F.lit("Moment type: "), _col(kind)), F.concat(F.lit("Lecturer said (+/-8s): "), clean(said)), F.concat(F.lit("On-screen text (OCR): "), clean(ocr))]
    lines += [F.concat(F.lit("What is on screen: "), clean(screen))] * with_screen
    lines.append(F.concat(F.lit("Pause available after the moment: "), F.coalesce(_col(pause).cast("string"), F.lit("0")), F.lit("s")))
    return F.concat_ws("\n", *lines)


def parse_reference(reply) -> Column:
    """P-10: (coverage, emit, ad_text, rung) of a reply; null without a known coverage and a stated decision."""
    body = replies.extract_json(_col(reply))
    value = lambda name: F.get_json_object(body, f"$.{name}")
    there = value("coverage").isin(*COVERAGE) & value("emit").isNotNull()
    fields = F.struct(value("coverage").alias("coverage"), (value("emit") == "true").alias("emit"), value("ad_text").alias("ad_text"), value("rung").try_cast("int").alias("rung"))
    return F.when(there, fields)


def reference_rows(answers: DataFrame, contexts: DataFrame, window: str, moment: str = "moment_id") -> DataFrame:
    """D-26: a row per answer: with the context that it was given, or with its error where it can't be used.

    answers: (moment, writer, decision as by :func:`parse_reference`, error, raw).
    """
    usable = F.col("error").isNull() & F.col("decision").isNotNull()
    joined = answers.join(contexts, moment)
    own = lambda c: F.when(usable, c)
    return joined.select(
        ids.description_id(moment, "writer").alias("output_id"),
        F.col("writer").alias("family"),
        *(own(F.col("decision")[name]).alias(name) for name in ("emit", "ad_text", "rung", "coverage")),
        *(own(F.coalesce(F.col(name), F.lit(""))).alias(name) for name in ("type", "transcript_window", "slide_ocr")),
        own(F.coalesce("pause_after", F.lit(0.0))).alias("pause_after"),
        own(F.lit(window)).alias("emit_window"),
        F.when(~usable, F.coalesce("error", F.lit("unparsed"))).alias("error"),
        F.when(~usable, F.col("raw")).alias("raw"),
    )


def rules_in_order(broken, sequence) -> Column:
    """U-05: a row's broken rules, then those of the sequence, each at its first place only."""
    return F.array_distinct(F.concat(_col(broken), _col(sequence)))


def grid(spark, lists: dict[str, list]) -> DataFrame:
    """D-28: every combination of the lists' entries, numbered; a table of the caller's own size."""
    rows = [(k, *map(str, cell)) for k, cell in enumerate(product(*lists.values()))]
    return spark.createDataFrame(rows, "cell int, " + ", ".join(f"{name} string" for name in lists))


def layered(*layers: dict) -> dict:
    """M-06, V-18: settings over settings: nested maps are merged, other values replaced by the later layer."""
    out: dict = {}
    for layer in layers:
        for name, value in layer.items():
            both = isinstance(value, dict) and isinstance(out.get(name), dict)
            out[name] = layered(out[name], value) if both else value
    return out


def resolve_settings(settings: dict, environment: dict[str, str], known: set[str] | None = None) -> dict:
    """V-07, V-18: ``${NAME}`` replaced by the environment's value; unset names, absolute paths and unknown keys are refused."""
    import re

    def resolve(value, where: str):
        if isinstance(value, dict):
            return {k: resolve(v, f"{where}.{k}") for k, v in value.items()}
        if isinstance(value, list):
            return [resolve(v, f"{where}[{i}]") for i, v in enumerate(value)]
        if not isinstance(value, str):
            return value
        if value.startswith("/"):
            raise ValueError(f"{where}: an absolute path ties the settings to one machine")
        unset = [n for n in re.findall(r"\$\{(\w+)\}", value) if n not in environment]
        if unset:
            raise ValueError(f"{where}: {unset} are not set")
        return re.sub(r"\$\{(\w+)\}", lambda m: environment[m[1]], value)

    unknown = sorted(set(settings) - known) if known is not None else []
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return {k: resolve(v, k) for k, v in settings.items()}
