"""The evaluation suite: every table that the given inputs allow, over one scored relation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.functions import statistics
from lectio.functions import text as tx
from lectio.operators import compliance, decisions, sequence
from lectio.sources.shared import written_once

#: Tables and the inputs that they need.
TABLES = {
    "systems": ("predictions", "moments"),
    "summary": ("predictions", "moments"),
    "rules_broken": ("predictions", "moments"),
    "rank_stability": ("predictions", "moments"),
    "reference_writers": ("references", "moments"),
    "pair_validity": ("pairs", "decisions"),
    "localisation": ("pairs", "subscores"),
    "rater_agreement": ("pairs", "labels", "scores"),
    "win_rate": ("outcomes",),
}
KNEES = (0.2, 0.3, 0.4, 0.5, 0.6)
#: A comparison has so many systems at most.
SYSTEMS = 1000


@dataclass
class Evaluation:
    """The tables by name, and why each other one was left out."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    left_out: dict[str, str] = field(default_factory=dict)


def score_all(predictions: DataFrame, moments: DataFrame, rules: DataFrame, system: str = "system", complete: bool = True, local: tuple | None = None) -> DataFrame:
    """D-18, D-19: every system's predictions scored on the moments, a row per system and moment, as one relation with ``key``.

    With ``complete`` False a system is scored on the moments that it described, as the writers of references are.
    """
    names = [r[0] for r in predictions.select(system).distinct().orderBy(system).limit(SYSTEMS + 1).collect()]
    if len(names) > SYSTEMS:
        raise ValueError(f"more than {SYSTEMS} systems")
    listed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    key = F.concat_ws("::", "moment_id", system)
    contexts = moments.select("*", F.explode(listed).alias(system)).withColumn("key", key)
    said = predictions.select("moment_id", F.col(system), "ad_text").withColumn("key", key)
    if not complete:
        said = said.where(~tx.is_unfilled("ad_text"))
        contexts = contexts.join(said.select("key"), "key", "left_semi")
    return compliance.score_predictions(said.select("key", "ad_text"), contexts, rules, "key", "lecture", ["t", "moment_id"], local, by=(system,))


def by_knee(scored: DataFrame, system: str = "system", knees: tuple[float, ...] = KNEES) -> DataFrame:
    """W-15: (knee, system, score): each system's mean under each knee, from one novelty."""
    base = F.when(F.col("novelty_factor") == 0, 0.0).otherwise(F.try_divide("overall", "novelty_factor"))
    each = scored.where("overall IS NOT NULL").withColumn("base", base).withColumn("knee", F.explode(F.array(*map(F.lit, knees))))
    return each.groupBy("knee", system).agg(F.avg(F.col("base") * F.least(F.lit(1.0), F.col("novelty") / F.col("knee"))).alias("score"))


def stability(scored: DataFrame, system: str = "system", knees: tuple[float, ...] = KNEES) -> DataFrame:
    """W-15: (knee, n, rho) of each knee's order of the systems against the first knee's."""
    per = written_once(by_knee(scored, system, knees), "knees")
    first = per.where(F.col("knee") == knees[0]).select(system, F.col("score").alias("x"))
    return statistics.spearman_frame(per.where(F.col("knee") != knees[0]).join(first, system), "x", "score", ["knee"])


def evaluate(inputs: dict[str, DataFrame], rules: DataFrame, where: str | None = None, local: tuple | None = None) -> Evaluation:
    """Every table of TABLES whose inputs are given; the scored relation is written once and read by all tables over it.

    inputs: predictions (moment_id, system, ad_text), moments (their contexts), references (moment_id, system, ad_text), pairs (pair_id, axis,
    compliant_side, stratum), decisions (pair_id, decision, by), scores (pair_id, scorer, a, b), subscores (pair_id, category, a, b), labels
    (rater, pair_id, side), outcomes (moment_id, outcome). ``where`` names a folder that keeps the tables; each is written there.
    """
    unknown = sorted(set(inputs) - {need for needs in TABLES.values() for need in needs})
    if unknown:
        raise ValueError(f"no inputs called {unknown}")
    out = Evaluation()
    missing = {name: [need for need in needs if need not in inputs] for name, needs in TABLES.items()}
    out.left_out = {name: "nothing was given for " + ", ".join(gone) for name, gone in missing.items() if gone}
    parts = compliance.LOCAL if local else compliance.MECHANICAL
    runs = lambda name: not missing[name]
    found: dict[str, DataFrame] = {}
    if runs("systems"):
        scored = written_once(score_all(inputs["predictions"], inputs["moments"], rules, local=local), "scored", where)
        found["systems"] = sequence.ranks(compliance.system_scores(scored, ["system"]), [], "score", "system")
        found["summary"] = compliance.summarise(scored, parts=parts)
        found["rules_broken"] = compliance.rule_diagnostic(scored, rules, "key", parts=parts)
        found["rank_stability"] = stability(scored)
    if runs("reference_writers"):
        own = written_once(score_all(inputs["references"], inputs["moments"], rules, complete=False, local=local), "scored_references", where)
        found["reference_writers"] = compliance.system_scores(own, ["system"])
    if runs("pair_validity"):
        known = inputs["pairs"].select("pair_id", "axis", "compliant_side")
        found["pair_validity"] = decisions.measure(decisions.verdicts_against(inputs["decisions"], known), ["axis"])
    if runs("localisation"):
        found["localisation"] = decisions.localisation(inputs["pairs"].select("pair_id", "axis", "compliant_side"), inputs["subscores"])
    if runs("rater_agreement"):
        found["rater_agreement"] = decisions.rater_report(inputs["labels"], inputs["scores"], inputs["pairs"])
    if runs("win_rate"):
        found["win_rate"] = decisions.win_rate(inputs["outcomes"])
    out.tables = {name: written_once(table, name, where) if where else table for name, table in found.items()}
    return out
