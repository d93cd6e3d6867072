"""Compliance scoring, its summary and its rule diagnostic (D-09 to D-19, A-03 to A-07, J-19, J-20, PRJ-10, PRJ-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectio.functions import scoring, statistics
from lectio.functions import text as tx
from lectio.operators.sequence import within_lecture_novelty
from lectio.sources.shared import written_once

# Fixed values: (rule, number, category, types, when described, when silent, route, checks) of the published rules.
RULES = (
    ("cross_cutting_001", 1, "cross_cutting", "all", True, True, "mechanical", "nonredundancy_now"),
    ("cross_cutting_002", 2, "cross_cutting", "all", True, False, "mechanical", "style_meta;style_pronoun;style_v2"),
    ("cross_cutting_003", 3, "cross_cutting", "all", True, False, "judge", ""),
    ("cross_cutting_004", 4, "cross_cutting", "all", True, False, "mechanical", "term_grounding"),
    ("cross_cutting_005", 5, "cross_cutting", "all", True, True, "mechanical", "faithfulness_nli"),
    ("cross_cutting_006", 6, "cross_cutting", "all", True, True, "unscored", ""),
    ("cross_cutting_007", 7, "cross_cutting", "all", True, True, "mechanical", "nonredundancy_ahead"),
    ("cross_cutting_008", 8, "cross_cutting", "all", True, True, "unscored", ""),
    ("length_001", 9, "length", "all", True, False, "unscored", ""),
    ("length_002", 10, "length", "all", True, False, "judge", ""),
    ("length_003", 11, "length", "all", True, False, "mechanical", "rung_reachable"),
    ("length_004", 12, "length", "all", True, False, "mechanical", "length_budget"),
    ("length_005", 13, "length", "all", False, True, "unscored", ""),
    ("slide_text_001", 14, "slide_text", "slide,reveal,transition", True, False, "judge", ""),
    ("slide_text_002", 15, "slide_text", "slide,reveal,transition", True, True, "penalty", "slide_copy_verbatim"),
    ("slide_transition_001", 16, "slide_transition", "transition", True, True, "mechanical", "transition_effect"),
    ("slide_animation_001", 17, "slide_animation", "animation,reveal", True, True, "judge", ""),
    ("slide_animation_002", 18, "slide_animation", "animation,reveal", True, False, "judge", ""),
    ("figure_001", 19, "figure", "figure", True, False, "mechanical", "faithfulness_nli"),
    ("figure_002", 20, "figure", "figure", True, False, "judge", ""),
    ("figure_003", 21, "figure", "figure", True, False, "judge", ""),
    ("figure_004", 22, "figure", "figure", True, False, "judge", ""),
    ("table_001", 23, "table", "table", True, False, "mechanical", "faithfulness_nli"),
    ("table_002", 24, "table", "table", True, False, "judge", ""),
    ("table_003", 25, "table", "table", True, False, "judge", ""),
    ("chart_001", 26, "chart", "chart", True, False, "mechanical", "faithfulness_nli"),
    ("chart_002", 27, "chart", "chart", True, False, "judge", ""),
    ("chart_003", 28, "chart", "chart", True, False, "judge", ""),
    ("math_typeset_001", 29, "math_typeset", "math", True, False, "mechanical", "faithfulness_nli"),
    ("math_typeset_002", 30, "math_typeset", "math", True, False, "judge", ""),
    ("math_typeset_003", 31, "math_typeset", "math", True, False, "judge", ""),
    ("code_001", 32, "code", "code", True, False, "unscored", ""),
    ("code_002", 33, "code", "code", True, False, "unscored", ""),
    ("code_003", 34, "code", "code", True, False, "unscored", ""),
    ("deixis_001", 35, "deixis", "pointing", True, False, "judge", ""),
    ("deixis_002", 36, "deixis", "pointing", True, True, "unscored", ""),
    ("deixis_003", 37, "deixis", "pointing", True, True, "unscored", ""),
    ("deixis_004", 38, "deixis", "pointing", True, False, "judge", ""),
    ("deixis_005", 39, "deixis", "pointing", True, False, "mechanical", "deixis_referent"),
    ("deixis_006", 40, "deixis", "pointing,ink", True, False, "mechanical", "deixis_overlay"),
    ("edge_cases_001", 41, "edge_cases", "all", True, True, "judge", ""),
    ("edge_cases_002", 42, "edge_cases", "all", True, False, "unscored", ""),
    ("visual_content_001", 43, "cross_cutting", "all", True, True, "unscored", ""),
    ("slide_text_003", 44, "dont_describe", "slide,reveal,transition", True, True, "penalty", "slide_copy_verbatim"),
    ("pair_perceptibility_001", 45, "cross_cutting", "all", False, False, "unscored", ""),
)
# The checks that each component implements, its category, and whether a shortfall breaks the rule.
CHECKS = {
    "style_properties": ("style_meta", "style_pronoun", "style_v2"),
    "terminology_grounding": ("term_grounding",),
    "length_budget_ratio": ("length_budget",),
    "deixis_resolution": ("deixis_referent", "deixis_overlay"),
    "faithfulness_nli": ("faithfulness_nli",),
    "non_redundancy_embedding": ("nonredundancy_now", "nonredundancy_ahead"),
}
BREACH = {"style_properties": True, "terminology_grounding": False, "length_budget_ratio": True, "deixis_resolution": True, "faithfulness_nli": False, "non_redundancy_embedding": False}
SEQUENCE_RULES = ("cross_cutting_006", "slide_text_003")
MECHANICAL = {"style": "style_properties", "terminology": "terminology_grounding", "length": "length_budget_ratio", "deixis": "deixis_resolution"}


def rule_table(spark: SparkSession) -> DataFrame:
    """SRC-19: rule, number, category, types, when_described, when_silent, route, checks; a table of fixed size."""
    raw = spark.createDataFrame(list(RULES), "rule string, number int, category string, types string, when_described boolean, when_silent boolean, route string, checks string")
    listed = lambda c, by: F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")
    return raw.withColumn("types", listed("types", ",")).withColumn("checks", listed("checks", ";"))


def applies(kind: Column, described: Column) -> Column:
    """PRJ-10, on the columns of the rule table."""
    return (F.array_contains("types", "all") | F.array_contains(F.col("types"), kind)) & F.when(described, F.col("when_described")).otherwise(F.col("when_silent"))


def applicable_rules(rows: DataFrame, rules: DataFrame, kind: str = "type", described: str = "described") -> DataFrame:
    """PRJ-11: per row the rules that apply, by number.

    The rules depend on (type, described) alone: they are found for the few distinct pairs, then joined.
    """
    pairs = rows.select(kind, described).distinct()
    found = pairs.join(F.broadcast(rules), applies(F.col(kind), F.col(described))).groupBy(kind, described).agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "rule"))), lambda x: x["rule"]).alias("rules"))
    same = F.col(f"r.{kind}").eqNullSafe(F.col(f"f.{kind}")) & F.col(f"r.{described}").eqNullSafe(F.col(f"f.{described}"))
    return rows.alias("r").join(found.alias("f"), same, "left").select("r.*", F.coalesce("f.rules", F.array().cast("array<string>")).alias("rules"))


def component_rules(rules: DataFrame) -> DataFrame:
    """J-20: (component, rule, number, types, ...) through the checks."""
    spark = rules.sparkSession
    checks = spark.createDataFrame([(c, k) for c, ks in CHECKS.items() for k in ks], "component string, check string")
    return rules.withColumn("check", F.explode("checks")).join(F.broadcast(checks), "check").drop("check", "checks").distinct()


def components(text: str, premise, pause: str, renders_cursor: str) -> dict[str, Column]:
    """The four mechanical components; deixis is null where it is stated that no pointer is drawn."""
    return {
        "style": scoring.style_score(text),
        "terminology": scoring.terminology_score(text, premise),
        "length": scoring.length_score(text, pause),
        "deixis": F.when(~F.col(renders_cursor).eqNullSafe(F.lit(False)), scoring.deixis_score(text, premise)),
    }


def score(rows: DataFrame, text: str = "ad_text", pause: str = "pause_after", renders_cursor: str = "renders_cursor") -> DataFrame:
    """D-09: columns style, terminology, length, deixis, overall (mean of those that apply) and reason.

    An unfilled description keeps its row, with null scores and the reason.
    """
    premise = tx.slide_premise("slide_ocr", "what_on_screen")
    unfilled = tx.is_unfilled(text)
    scored = rows.withColumns({k: F.when(~unfilled, v) for k, v in components(text, premise, pause, renders_cursor).items()})
    values = F.filter(F.array(*[c for c in MECHANICAL]), lambda x: x.isNotNull())
    overall = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(values), F.lit(1))
    return scored.withColumn("overall", F.when(~unfilled, overall)).withColumn("reason", F.when(unfilled, "unfilled"))


LOCAL = {**MECHANICAL, "faithfulness": "faithfulness_nli", "non_redundancy": "non_redundancy_embedding"}


def stand_in_contradiction(premise: Column, text: Column) -> Column:
    """1 where the text says "not" and the premise doesn't, else 0: a model of contradiction for tests."""
    says = lambda c: F.array_contains(tx.token_set(c), "not")
    return (says(text) & ~says(premise)).cast("double")


def stand_in_similarity(a: Column, b: Column) -> Column:
    """Overlap of token sets: a model of similarity for tests."""
    return tx.jaccard(tx.token_set(a), tx.token_set(b))


def score_local(scored: DataFrame, contradiction, similarity, text: str = "ad_text", said: str = "transcript_window", knee: float = 0.17) -> DataFrame:
    """D-14, D-15, D-16: mechanically scored rows with faithfulness and non_redundancy too, and overall over all six.

    ``contradiction`` and ``similarity`` take two text columns and give a column: a native expression or
    an Arrow UDF around a model. An empty description, premise or transcript scores 1.
    """
    body, premise = tx.clean_description(text), tx.slide_premise("slide_ocr", "what_on_screen")
    spoken = F.trim(F.coalesce(F.col(said), F.lit("")))
    faithful = F.when((body == "") | (premise == ""), 1.0).otherwise(1 - contradiction(premise, body))
    fresh = F.when((body == "") | (spoken == ""), 1.0).otherwise(scoring.credit_for_similarity(similarity(body, spoken), knee))
    there = F.col("overall").isNotNull()
    out = scored.withColumn("faithfulness", F.when(there, faithful)).withColumn("non_redundancy", F.when(there, fresh))
    values = F.array_compact(F.array(*LOCAL))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return out.withColumn("overall", F.when(there, total / F.greatest(F.size(values), F.lit(1))))


def require_factor(scored: DataFrame) -> DataFrame:
    """Q-14: refuses rows that were scored without the sequence factor, or none that was scored."""
    if "novelty_factor" not in scored.columns or scored.where("overall IS NOT NULL AND novelty_factor IS NOT NULL").isEmpty():
        raise ValueError("no scored row carries the sequence factor; score the predictions as a system first")
    return scored


def require_components(names, mode: str) -> None:
    """Q-12: a mode's scorer has exactly its components."""
    promised = set({"mechanical": MECHANICAL, "local": LOCAL}[mode])
    if set(names) != promised or len(list(names)) != len(promised):
        raise ValueError(f"mode {mode} promises {sorted(promised)} but was given {sorted(names)}")


def with_novelty(scored: DataFrame, lecture: str, order: list[str], text: str = "ad_text", knee: float = 0.4, by: tuple[str, ...] = ()) -> DataFrame:
    """W-03: novelty and its factor for scored rows, multiplied into overall; others are left alone.

    ``by`` names further columns (a system) that keep sequences apart. Novelty reads only the texts of
    the rows without a ``reason``, so that the components are evaluated once, for the rows themselves.
    """
    keyed = scored.withColumn("_seq", F.concat_ws("\u0001", F.col(lecture), *by))
    out = within_lecture_novelty(keyed, "_seq", order, text, among=F.col("reason").isNull())
    factor = scoring.novelty_factor("novelty", knee)
    return out.withColumn("novelty_factor", factor).withColumn("overall", F.col("overall") * F.col("novelty_factor")).drop("_seq")


def summarise(scored: DataFrame, group: str = "type", moment: str = "moment_id", parts: dict[str, str] | None = None) -> DataFrame:
    """A-02, A-03: one row per group and one for all (group null): counts, mean, median, and per component the same.

    Per component: rows it applied to, rows it was left out of, mean, median, rows of full credit and their share. Counts
    and means come from one pass by grouping sets, medians by refinement, so that no group's values meet in one task.
    """
    parts = MECHANICAL if parts is None else parts
    there = F.col("overall").isNotNull()
    stratum = F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown"))
    named = written_once(scored.select(stratum.alias("stratum"), "reason", "overall", moment, *parts), "summary-rows")  # counts and medians read the scores again
    own = []
    for c in parts:
        value = F.when(there, F.col(c))
        own += [F.count(value).alias(f"{c}_n"), F.count_if(there & F.col(c).isNull()).alias(f"{c}_abstained"), F.avg(value).alias(f"{c}_mean"), F.count_if(value >= 1.0).alias(f"{c}_compliant")]
    measures = [F.count("*").alias("n_total"), F.count("overall").alias("n_scored"), F.count_if(F.col("reason") == "unfilled").alias("n_unfilled"), F.count_if(F.col("reason") == "missing").alias("n_missing"), F.count_distinct(moment).alias("n_moments"), F.avg("overall").alias("mean"), *own]
    sums = named.groupingSets([[F.col("stratum")], []], F.col("stratum")).agg(*measures)
    shares = sums.withColumns({f"{c}_share": F.try_divide(f"{c}_compliant", f"{c}_n") for c in parts})
    entries = F.array(*[F.struct(F.lit(name).alias("_name"), v.alias("_value")) for name, v in (("median", F.col("overall")), *((f"{c}_median", F.when(there, F.col(c))) for c in parts))])
    long = named.select("stratum", F.explode(entries).alias("_e")).select(F.explode(F.array(F.col("stratum"), F.lit(None).cast("string"))).alias("stratum"), "_e.*")
    medians = statistics.medians(long, ["stratum", "_name"], "_value").groupBy("stratum").pivot("_name", ["median", *(f"{c}_median" for c in parts)]).agg(F.first("median"))
    joined = shares.join(medians.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left").drop("_s")
    order = ["stratum", "n_total", "n_scored", "n_unfilled", "n_missing", "n_moments", "mean", "median"]
    return joined.select(*order, *(f"{c}_{x}" for c in parts for x in ("n", "abstained", "mean", "median", "compliant", "share")))


def system_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """A-04, A-06: mean and count of scored rows, rows and described rows per system (and seed)."""
    return scored.groupBy(*by).agg(F.avg("overall").alias("score"), F.count("overall").alias("n_scored"), F.count("*").alias("n_moments"))


def over_seeds(per_seed: DataFrame, system: str, seed: str) -> DataFrame:
    """A-07: mean of the seeds' means, rounded mean of counts, the seeds in order."""
    return per_seed.groupBy(system).agg(F.avg("score").alias("score"), F.round(F.avg("n_scored")).cast("long").alias("n_scored"), F.array_join(F.array_sort(F.collect_set(F.col(seed).cast("string"))), ",").alias("seeds"))


def reached_rules(rules: DataFrame, parts: dict[str, str] = MECHANICAL) -> DataFrame:
    """J-20: (component, rule, number, types, ..., broken) of the components of a mode, MECHANICAL or LOCAL; the sequence factor is one too."""
    own = component_rules(rules).where(F.col("component").isin(*parts.values()))
    breach = F.create_map(*[F.lit(x) for c in parts.values() for x in (c, BREACH[c])])
    again = rules.where(F.col("rule").isin(*SEQUENCE_RULES)).drop("checks").withColumn("component", F.lit("sequence")).withColumn("broken", F.lit(True))
    return own.withColumn("broken", breach[F.col("component")]).unionByName(again)


def unreached_rules(rules: DataFrame, parts: dict[str, str] = MECHANICAL) -> DataFrame:
    """A-05: the rules that no check of the mode and no sequence factor can speak for, by number."""
    return rules.join(F.broadcast(reached_rules(rules, parts).select("rule").distinct()), "rule", "left_anti").select("rule", "number", "category", "route")


def with_lists(scored: DataFrame, rules: DataFrame, parts: dict[str, str] = MECHANICAL, kind: str = "type") -> DataFrame:
    """D-09, D-17, U-05: ``abstained`` (categories without a value), ``broken`` and ``short`` (rules of components below full credit) of scored rows.

    Rules come in the order of the categories, then of their numbers, each at its first place, those of the sequence
    factor last. A component whose shortfall is no breach names its rules in ``short``. A row without a score
    abstains on every category and names no rule. The rule table has a fixed size: it becomes a constant of the plan.
    """
    found: dict[str, list[tuple[str, list[str]]]] = {}
    for r in reached_rules(rules, parts).where("when_described").orderBy("number", "rule").limit(1000).collect():
        found.setdefault(r.component, []).append((r.rule, list(r.types)))

    def named(component: str) -> Column:
        each = [F.struct(F.lit(rule).alias("rule"), F.array(*map(F.lit, types)).alias("types")) for rule, types in found.get(component, [])]
        if not each:
            return F.array().cast("array<string>")
        own = F.filter(F.array(*each), lambda x: F.array_contains(x["types"], "all") | F.coalesce(F.array_contains(x["types"], F.col(kind)), F.lit(False)))
        return F.transform(own, lambda x: x["rule"])

    there, none = F.col("overall").isNotNull(), F.array().cast("array<string>")
    listed = lambda breach: [F.when(there & (F.col(c) < 1.0), named(parts[c])).otherwise(none) for c in scoring.CATEGORIES if c in parts and BREACH[parts[c]] == breach]
    repeats = F.when(there & (F.col("novelty_factor") < 1.0), F.array(*map(F.lit, SEQUENCE_RULES))).otherwise(none) if "novelty_factor" in scored.columns else none
    abstained = F.array_compact(F.array(*[F.when(~there | (F.col(c).isNull() if c in parts else F.lit(True)), F.lit(c)) for c in scoring.CATEGORIES]))
    joined = lambda lists: F.array_distinct(F.concat(none, *lists))
    return scored.withColumns({"abstained": abstained, "broken": joined([*listed(True), repeats]), "short": joined(listed(False))})


def score_predictions(predictions: DataFrame, contexts: DataFrame, rules: DataFrame, key: str, lecture: str, order: list[str], local: tuple | None = None, knee: float | None = 0.4, by: tuple[str, ...] = ()) -> DataFrame:
    """D-18, J-01, J-02: one row per context: every prediction scored with its lists, and the contexts that none reached.

    A prediction without a context, or a second one, fails the query. ``local`` gives the models of
    :func:`score_local` and with them the local mode; ``knee`` None leaves the sequence factor out. A row that isn't scored
    says why: unfilled or missing.
    """
    from lectio.operators.moments import with_context

    parts = LOCAL if local else MECHANICAL
    rows = score(with_context(predictions, contexts, key))
    if local:
        rows = score_local(rows, *local)
    if knee is not None:
        rows = with_novelty(rows, lecture, order, knee=knee, by=by)
    missing = contexts.join(predictions.select(key), key, "left_anti").withColumn("reason", F.lit("missing"))
    return with_lists(rows.unionByName(missing, allowMissingColumns=True), rules, parts)


def broken_rules(scored: DataFrame, rules: DataFrame, key: str, kind: str = "type", parts: dict[str, str] = MECHANICAL) -> DataFrame:
    """D-17, D-18: (key, rule, broken, overall): rules of a component below 1 that apply to the row's type; sequence rules where the factor is below 1."""
    values = {parts[c]: F.col(c) for c in parts} | {"sequence": F.col("novelty_factor")}
    lower = F.filter(F.array(*[F.struct(F.lit(c).alias("component"), v.alias("value")) for c, v in values.items()]), lambda p: p["value"] < 1.0)
    short = scored.where("overall IS NOT NULL").select(key, kind, "overall", F.explode(lower).alias("p")).select(key, kind, "overall", "p.component")
    found = short.join(F.broadcast(reached_rules(rules, parts)), "component").where(applies(F.col(kind), F.lit(True)))
    return found.groupBy(key, "rule", "broken").agg(F.first("overall").alias("overall"))


def rule_diagnostic(scored: DataFrame, rules: DataFrame, key: str, kind: str = "type", examples: int = 3, parts: dict[str, str] = MECHANICAL) -> DataFrame:
    """A-05, K-07, K-09: per rule within reach of the mode: rows it applies to, broken, below full credit, lowest examples.

    The lowest examples are kept by a running minimum in each task before they meet, so that a rule which
    every row breaks gathers no rows.
    """
    within = rules.join(F.broadcast(reached_rules(rules, parts).select("rule").distinct()), "rule")
    kinds = scored.where("overall IS NOT NULL").groupBy(kind).agg(F.count("*").alias("n"))
    totals = within.join(F.broadcast(kinds), applies(F.col(kind), F.lit(True)), "left").groupBy("rule", "number", "route").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("applies_to"))
    hits = broken_rules(scored, rules, key, kind, parts)
    per = hits.groupBy("rule").agg(F.count_if("broken").alias("broken_by"), F.count_if(~F.col("broken")).alias("below"))
    lowest = hits.where("broken").withColumn("_part", F.pmod(F.xxhash64(key), F.lit(256)))
    for group in (["rule", "_part"], ["rule"]):
        first = Window.partitionBy(*group).orderBy("overall", key)
        lowest = lowest.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= examples)
    named = lowest.groupBy("rule").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("overall", key))), lambda x: x[key].cast("string")), ",").alias("examples"))
    out = totals.join(per, "rule", "left").join(named, "rule", "left").fillna(0, ["broken_by", "below"])
    share = lambda c: F.try_divide(F.col(c), F.col("applies_to"))
    return out.withColumn("share_broken", share("broken_by")).withColumn("share_below", share("below")).withColumn("graded", (F.col("below") > 0) & (F.col("broken_by") == 0))
