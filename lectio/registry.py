"""Named, interchangeable parts (2.13): functions that give columns or frames, by family and name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import functions as F

from lectio.functions import overlap, replies, scoring, statistics
from lectio.functions import text as tx
from lectio.operators import channels, compliance, decisions, detection, joins, moments, sampling, sequence
from lectio.sources import external, lectures


class Registry:
    def __init__(self):
        self.families: dict[str, dict[str, Callable]] = {}

    def register(self, family: str, name: str, part: Callable) -> Callable:
        if name in self.families.setdefault(family, {}):
            raise ValueError(f"{family} {name} is registered twice")
        self.families[family][name] = part
        return part

    def names(self, family: str) -> tuple[str, ...]:
        return tuple(sorted(self.families[family]))

    def create(self, family: str, spec: str | dict) -> Callable:
        """A part with its parameters bound: a name, or {name, params}; unknown ones are refused."""
        name, params = (spec, {}) if isinstance(spec, str) else (spec["name"], spec.get("params", {}))
        if name not in self.families.get(family, {}):
            raise ValueError(f"no {family} called {name}; known: {list(self.families.get(family, {}))}")
        part = self.families[family][name]
        unknown = sorted(set(params) - set(inspect.signature(part).parameters))
        if unknown:
            raise ValueError(f"{family} {name} takes no {unknown}")
        return lambda *args, **more: part(*args, **params, **more)


def _window(before: float, after: float):
    """A transcript window: the words from ``before`` seconds before a moment to ``after`` seconds after it."""
    return lambda words, rows, lecture, key: joins.words_between(words, rows, lecture, key, F.col("t") - before, F.col("t") + after, before + after)


def _axis(name: str):
    return lambda kind: F.array_contains(moments.axes_for(kind), name)


def _attempts(*temperatures: float):
    return lambda rows, generate, read, **more: external.decode(rows, generate, temperatures, read, **more)


def _visual(channel: str):
    return lambda pairs: detection.visual_events(pairs).where(F.col("channel") == channel)


PARTS = Registry()
for _family, _parts in {
    "agreement coefficient": {"krippendorff_nominal": statistics.krippendorff},
    "candidate mode": {"verbalized_sampling": lambda reply, schema: replies.parse_candidates(reply, schema), "per_call": lambda reply, schema: F.slice(replies.parse_candidates(reply, schema), 1, 1)},
    "compliance component": {"style_properties": scoring.style_score, "terminology_grounding": scoring.terminology_score, "length_budget_ratio": scoring.length_score, "deixis_resolution": scoring.deixis_score, "non_redundancy_embedding": scoring.credit_for_similarity, "faithfulness_nli": lambda premise, text, contradiction=compliance.stand_in_contradiction: 1 - contradiction(premise, text)},
    "context source": {"reference_rows": sequence.first_row_per, "in_memory": lambda spark, rows, schema: spark.createDataFrame(rows, schema)},
    "controlled axis": {name: _axis(name) for name in moments.AXES},
    "dataset source": {"hub": lectures.Catalogue, "local_dir": lectures.Catalogue},
    "decoding attempt": {"greedy": _attempts(0.0), "sampled": _attempts(0.0, 0.7)},
    "description system": {"adapter": external.decode, "zero_shot": external.decode, "slide_title": tx.slide_title, "reference_writer": moments.own_moments},
    "frame channel": {"pixel_motion": channels.pixel_motion, "slide_turnover": _visual("slide_turnover"), "added_words": _visual("added_words")},
    "gap channel": {"speech_gap": sequence.usable_gaps},
    "input arm": {"multimodal": lambda *c: moments.package_text(*c, False), "text_only": lambda *c: moments.package_text(*c, True)},
    "interval estimator": {"cluster_bootstrap": statistics.cluster_bootstrap_mean, "bootstrap": statistics.unit_bootstrap_mean},
    "judge": {"video_pairwise": replies.parse_choice, "text_pairwise": replies.parse_choice, "sheet_pairwise": replies.parse_choice, "rubric": replies.parse_rubric, "reference_rating": replies.parse_scale, "reference_rating_pooled": replies.parse_scale, "rule_compliance": replies.parse_verdict},
    "metric": {"chrf": overlap.chrf, "clipscore": scoring.clip_score, "compliance": compliance.score, "reference_rating": scoring.normalised_rating, "rubric": replies.parse_rubric, "bertscore": scoring.rescale},
    "model provider": {"gemini_native": lambda post, **settings: external.asker(post, external.native_request, **settings), "openai_compatible": external.asker, "huggingface_local": lambda generate: generate},
    "multiple-test correction": {"holm": statistics.holm},
    "order combination": {"agree_or_undecided": decisions.outcomes, "agree_or_tie": lambda answers: decisions.outcomes(answers, "agree_or_tie")},
    "pair decision rule": {"single_scorer": decisions.single_scorer, "cascade": decisions.cascade},
    "paired test": {"exact_mcnemar": statistics.mcnemar},
    "pairing rule": {"all_pairs": lambda a, b: decisions.mcnemar_counts(a, b, False), "both_decide": decisions.mcnemar_counts},
    "reference prompt": {"fixed_window": external.render, "next_event_window": external.render, "visual_condition": external.render},
    "rung policy": {"rung_budgets": lambda pause: scoring.reachable_rung(pause, scoring.RUNG_WORDS), "uniform_budget": scoring.reachable_rung},
    "salvage step": {"strict_object": lambda c: replies.salvaged(c, "strict_object"), "balanced_object": lambda c: replies.salvaged(c, "balanced_object"), "open_string": lambda c: replies.salvaged(c, "open_string")},
    "sequence factor": {"novelty_knee": scoring.novelty_factor},
    "slide text reader": {"easyocr": external.slide_text},
    "speech gap detector": {"silero": external.speech_by},
    "split policy": {"manifest": sampling.side_of, "dataset_split": lambda rows, train, test, lecture: sampling.side_of(rows, train.select(F.col(lecture).alias("lecture_id"), F.lit("train").alias("split")).distinct().unionByName(test.select(F.col(lecture).alias("lecture_id"), F.lit("test").alias("split")).distinct()), lecture)},
    "still policy": {"event_window": scoring.event_window, "keyframe_window": joins.keyframe_band},
    "training method": {"sft": lambda rows: external.training_table(rows, "sft"), "dpo": lambda rows: external.training_table(rows, "dpo")},
    "transcriber": {"hosted_whisper": external.shift_chunks},
    "transcript window": {"symmetric": lambda seconds=8.0: _window(seconds, seconds), "fixed": lambda before=5.0, after=8.0: _window(before, after), "next_event": sequence.next_event_span},
}.items():
    for _name, _part in _parts.items():
        PARTS.register(_family, _name, _part)
