"""Pairs, decisions and raters (D-01 to D-08, A-08 to A-16, A-20 to A-22, V-01, U-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectio.operators.moments import failing

SIDES = ("a", "b")
TIE = "tie"


def preferred(a="a", b="b") -> Column:
    """D-01: a, b, or null for a tie or a missing score."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(x > y, "a").when(y > x, "b")


def tied(a="a", b="b") -> Column:
    return (F.col(a) == F.col(b)) & F.col(a).isNotNull()


def single_scorer(scores: DataFrame, scorer: str) -> DataFrame:
    """D-02: (pair_id, decision, by)."""
    return scores.where(F.col("scorer") == scorer).select("pair_id", preferred().alias("decision"), F.when(preferred().isNotNull(), scorer).alias("by"))


def cascade(scores: DataFrame, order: list[str]) -> DataFrame:
    """D-03: the first scorer in order that decides; ``by`` says which."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("scorer"))
    ranked = scores.where(F.col("scorer").isin(order)).withColumn("side", preferred()).withColumn("rank", F.when(F.col("side").isNotNull(), rank))
    first = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "side", "scorer")))
    return ranked.groupBy("pair_id").agg(first.alias("f")).select("pair_id", F.col("f.side").alias("decision"), F.col("f.scorer").alias("by"))


def verdicts_against(decisions: DataFrame, known: DataFrame) -> DataFrame:
    """D-04: right, wrong, or null where undecided, on pairs whose compliant side is known (PRJ-06)."""
    sides = known.where(F.col("compliant_side").isin(*SIDES))
    return decisions.join(sides, "pair_id").withColumn("right", F.col("decision") == F.col("compliant_side"))


def measure(verdicts: DataFrame, by: list[str] | None = None, stage: str = "by") -> DataFrame:
    """A-08, A-09: pairs, decided, ties (undecided), right, coverage, accuracy, accuracy with undecided pairs as failures, and decided_by.

    decided_by maps each stage that decided a pair to how many it did; counts per stage are summed first,
    so a group's map has as many entries as there are stages.
    """
    keys = list(by or [])
    per = verdicts.withColumn("_stage", F.when(F.col("right").isNotNull(), F.col(stage))).groupBy(*keys, "_stage").agg(F.count("*").alias("_n"), F.count("right").alias("_d"), F.count_if("right").alias("_r"))
    entry = F.when(F.col("_stage").isNotNull() & (F.col("_d") > 0), F.struct("_stage", "_d"))
    n, decided, right = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_d"), F.lit(0)), F.coalesce(F.sum("_r"), F.lit(0))
    sums = per.groupBy(*keys).agg(n.alias("pairs"), decided.alias("decided"), right.alias("n_right"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("decided_by"))
    share = lambda x, y: F.try_divide(x, y)
    return sums.select(*keys, "pairs", "decided", (F.col("pairs") - F.col("decided")).alias("ties"), "n_right", share("decided", "pairs").alias("coverage"), share("n_right", "decided").alias("accuracy"), share("n_right", "pairs").alias("accuracy_all"), "decided_by")


def outcomes(answers: DataFrame, rule: str = "agree_or_undecided") -> DataFrame:
    """D-05, D-06, D-07: per moment both orders' sides, the combined outcome, and whether the judge flipped."""
    sides = answers.groupBy("moment_id").agg(F.max(F.when(F.col("order") == 0, F.col("choice"))).alias("first"), F.max(F.when(F.col("order") == 1, F.col("choice"))).alias("second"))
    same = F.col("first").isin(*SIDES) & (F.col("first") == F.col("second"))
    both_tie = (F.col("first") == TIE) & (F.col("second") == TIE)
    other = {"agree_or_undecided": F.lit("undecided"), "agree_or_tie": F.when(F.col("first").isNull() | F.col("second").isNull(), "undecided").otherwise(TIE)}[rule]
    flipped = F.col("first").isin(*SIDES) & F.col("second").isin(*SIDES) & (F.col("first") != F.col("second"))
    return sides.withColumn("outcome", F.when(same, F.col("first")).when(both_tie, TIE).otherwise(other)).withColumn("flipped", F.coalesce(flipped, F.lit(False)))


def win_rate(combined: DataFrame) -> DataFrame:
    """A-10: won and lost by side a, undecided, and the share won of those decided."""
    won, lost = F.count_if(F.col("outcome") == "a"), F.count_if(F.col("outcome") == "b")
    return combined.agg(won.alias("won"), lost.alias("lost"), (F.count("*") - won - lost).alias("undecided"), F.try_divide(won, won + lost).alias("win_rate"))


def agreement_between(first: DataFrame, second: DataFrame) -> DataFrame:
    """A-11: moments that both judges decide, and the share on which they agree."""
    a = first.where(F.col("outcome").isin(*SIDES)).select("moment_id", F.col("outcome").alias("x"))
    b = second.where(F.col("outcome").isin(*SIDES)).select("moment_id", F.col("outcome").alias("y"))
    return a.join(b, "moment_id").agg(F.count("*").alias("shared"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreed"))


def rater_cells(labels: DataFrame, scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A-12, A-13, J-13: per rater and scorer (and group): agreed, disagreed, ties of the metric, agreement."""
    joined = labels.where(F.col("side").isin(*SIDES)).join(scores, "pair_id").withColumn("found", preferred())
    agreed, disagreed = F.count_if(F.col("found") == F.col("side")), F.count_if(F.col("found") != F.col("side"))
    return joined.groupBy("rater", "scorer", *(by or [])).agg(agreed.alias("agreed"), disagreed.alias("disagreed"), F.count_if(tied()).alias("metric_ties"), F.try_divide(agreed, agreed + disagreed).alias("agreement"))


ORDER_SENSITIVE = "order_sensitive"


def rater_report(labels: DataFrame, scores: DataFrame, pairs: DataFrame, group: str = "axis", stratum: str = "stratum") -> DataFrame:
    """A-13: the cells of every rater and scorer: over all pairs, by group, and over the order-sensitive pairs, which are in no other cell.

    One pass by grouping sets: a row has its part (overall, by_group, order_sensitive), its group where the part
    has groups (natural where a pair has none), n, agreed, metric_ties and agreement. A cell without any choice has no row.
    """
    known = pairs.select("pair_id", F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("natural")).alias("group"), F.coalesce(F.col(stratum) == ORDER_SENSITIVE, F.lit(False)).alias("sensitive"))
    joined = labels.where(F.col("side").isin(*SIDES)).select("rater", "pair_id", "side").join(scores, "pair_id").join(known, "pair_id").withColumn("found", preferred())
    agreed, disagreed = F.count_if(F.col("found") == F.col("side")), F.count_if(F.col("found") != F.col("side"))
    columns = [F.col(c) for c in ("rater", "scorer", "sensitive", "group")]
    cells = joined.groupingSets([columns[:3], columns], *columns).agg(F.grouping("group").alias("whole"), agreed.alias("agreed"), disagreed.alias("disagreed"), F.count_if(tied()).alias("metric_ties"))
    part = F.when(F.col("sensitive"), F.lit(ORDER_SENSITIVE)).when(F.col("whole") == 1, "overall").otherwise("by_group")
    wanted = cells.where(~F.col("sensitive") | (F.col("whole") == 1))
    n = F.col("agreed") + F.col("disagreed")
    return wanted.select("rater", "scorer", part.alias("part"), "group", n.alias("n"), "agreed", "metric_ties", F.try_divide("agreed", n).alias("agreement"))


def unanimous(labels: DataFrame, n_raters: int) -> DataFrame:
    """A-20, A-21: pairs that every rater labelled, all the same side and none a tie."""
    per = labels.groupBy("pair_id").agg(F.count_distinct("rater").alias("raters"), F.min("side").alias("low"), F.max("side").alias("high"))
    return per.where(F.col("raters") == n_raters).withColumn("unanimous", (F.col("low") == F.col("high")) & (F.col("low") != TIE)).select("pair_id", "low", "unanimous")


def ties_per_rater(labels: DataFrame) -> DataFrame:
    """A-22."""
    return labels.groupBy("rater").agg(F.count_if(F.col("side") == TIE).alias("ties"), F.count("*").alias("n"))


def ordering_summary(combined: DataFrame) -> DataFrame:
    """A-16."""
    n = F.count("*")
    return combined.agg(n.alias("pairs"), F.count_if(F.col("outcome").isin(*SIDES)).alias("ordered"), F.count_if(F.col("outcome") == TIE).alias("tied"), F.count_if(F.col("outcome") == "undecided").alias("unordered"), F.count_if("flipped").alias("flipped"), F.try_divide(F.count_if("flipped"), n).alias("share_flipped"))


def localisation(pairs: DataFrame, subscores: DataFrame) -> DataFrame:
    """A-14: per category on its own pairs: decided, ties, right, Wilson bounds. subscores: pair_id, category, a, b."""
    from lectio.functions.statistics import wilson_columns

    own = pairs.where(F.col("compliant_side").isin(*SIDES)).join(subscores.withColumnRenamed("category", "axis"), ["pair_id", "axis"])
    per = own.withColumn("found", preferred()).groupBy("axis").agg(F.count("found").alias("decided"), F.count_if(tied()).alias("ties"), F.count_if(F.col("found") == F.col("compliant_side")).alias("n_right"))
    low, high = wilson_columns(F.col("n_right"), F.col("decided"))
    return per.withColumn("low", low).withColumn("high", high)


def preference_rows(pairs: DataFrame) -> DataFrame:
    """PRJ-17: prompt, chosen, rejected of pairs with a direction."""
    one = pairs.where(F.col("side").isin(*SIDES))
    first = F.col("side") == "a"
    return one.select("pair_id", "prompt", F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected"))


def mcnemar_counts(first: DataFrame, second: DataFrame, both_decide: bool = True) -> DataFrame:
    """T-07, T-09, U-03: pairs that both were asked (or both decide): shared, and right by one scorer only."""
    x, y = first.select("pair_id", F.col("right").alias("x")), second.select("pair_id", F.col("right").alias("y"))
    both = x.join(y, "pair_id")
    both = both.where("x IS NOT NULL AND y IS NOT NULL") if both_decide else both.fillna(False, ["x", "y"])
    return both.agg(F.count("*").alias("shared"), F.count_if(F.col("x") & ~F.col("y")).alias("only_first"), F.count_if(~F.col("x") & F.col("y")).alias("only_second"))


def paired_difference(first: DataFrame, second: DataFrame, key: list[str], value: str) -> DataFrame:
    """T-14, J-14: differences on the keys that both sides have."""
    return first.select(*key, F.col(value).alias("_x")).join(second.select(*key, F.col(value).alias("_y")), key).select(*key, (F.col("_x") - F.col("_y")).alias("difference"))


def _candidates(candidates: DataFrame, moment: str, ordinal: str, text: str, writer: str, most: int) -> DataFrame:
    """(moment, cs): a moment's candidates (o, t, w) in order; one with more than ``most`` fails the query."""
    numbered = candidates.withColumn("_n", F.count("*").over(Window.partitionBy(moment)))
    fault = F.when(F.col("_n") > most, F.concat(F.lit("moment "), F.col(moment).cast("string"), F.lit(f" has more than {most} candidates")))
    known = failing(numbered, fault)
    return known.groupBy(moment).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("t"), F.col(writer).alias("w")))).alias("cs"))


def candidate_pairs(candidates: DataFrame, moment: str, ordinal: str, text: str, writer: str, most: int = 64) -> DataFrame:
    """J-04: unordered pairs of one moment's candidates, of which there are a handful (the writers); a moment with more than ``most`` fails the query."""
    one = _candidates(candidates, moment, ordinal, text, writer, most)
    pairs = F.expr("flatten(transform(cs, (x, i) -> transform(slice(cs, i + 2, size(cs)), y -> struct(x AS first, y AS second))))")
    return one.select(moment, F.explode(pairs).alias("p")).select(moment, F.col("p.first.t").alias("a"), F.col("p.second.t").alias("b"), F.col("p.first.w").alias("a_writer"), F.col("p.second.w").alias("b_writer"), F.col("p.first.o").alias("a_ordinal"), F.col("p.second.o").alias("b_ordinal"))


def compared_pairs(candidates: DataFrame, moment: str, ordinal: str, text: str, writer: str, compare, most: int = 64) -> DataFrame:
    """J-04 with what ``compare`` says of each pair.

    ``compare`` takes the array of a moment's texts and gives an array of structs with i < j, the places of a pair, and further fields.
    """
    one = _candidates(candidates, moment, ordinal, text, writer, most).where(F.size("cs") > 1)
    met = one.withColumn("_x", compare(F.col("cs.t"))).select(moment, "cs", F.explode("_x").alias("_x")).select(moment, F.col("cs")[F.col("_x.i")].alias("f"), F.col("cs")[F.col("_x.j")].alias("s"), "_x.*").drop("i", "j")
    more = [c for c in met.columns if c not in (moment, "f", "s")]
    return met.select(moment, F.col("f.t").alias("a"), F.col("s.t").alias("b"), F.col("f.w").alias("a_writer"), F.col("s.w").alias("b_writer"), F.col("f.o").alias("a_ordinal"), F.col("s.o").alias("b_ordinal"), *more)


def spread_pairs(pairs: DataFrame, moment: str, cap: int = 4, per_description: int = 2, minimum: float = 12.0) -> DataFrame:
    """K-01: per moment the pairs across writers first, then the furthest apart, within the caps (a recurrence over the pairs in order)."""
    same = F.coalesce(F.col("a_writer") == F.col("b_writer"), F.lit(False))
    ranked = F.struct(same.alias("_same"), (-F.col("distance")).alias("_near"), "a_ordinal", "b_ordinal", F.struct(*pairs.columns).alias("_p"))
    listed = pairs.where(F.col("distance") >= minimum).groupBy(moment).agg(F.transform(F.sort_array(F.collect_list(ranked)), lambda x: x["_p"]).alias("_ps"))

    def keep(kept, x):
        uses = lambda text: F.size(F.filter(kept, lambda k: k["a"].eqNullSafe(text) | k["b"].eqNullSafe(text)))
        free = (F.size(kept) < cap) & (uses(x["a"]) < per_description) & (uses(x["b"]) < per_description)
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    return listed.select(F.explode(F.aggregate("_ps", F.slice("_ps", 1, 0), keep)).alias("_p")).select("_p.*")
