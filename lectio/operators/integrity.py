"""Assertions that raise and never filter (Q-01 to Q-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data break a promise that later steps rely on."""


def require_empty(bad: DataFrame, message: str, examples: int = 3) -> None:
    rows = bad.limit(examples).collect()
    if rows:
        raise ContractError(f"{message}: {[tuple(r) for r in rows]}")


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Q-01: keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *key: str) -> None:
    require_empty(repeated_keys(df, *key), f"{key} is not unique")


def require_no_leak(rows: DataFrame, manifest: DataFrame, lecture: str, side: str = "test") -> None:
    """Q-02: no row stems from a lecture of the other side."""
    other = manifest.where(F.col("split") == side).select(F.col("lecture_id").alias(lecture))
    require_empty(rows.join(other, lecture, "left_semi").select(lecture).distinct(), f"rows of the {side} side")


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def require_disjoint(a: DataFrame, b: DataFrame, key: str, within: str | None = None) -> None:
    """Q-03, Q-04, Q-07: no key on both sides; with ``within``, they must share one of those to show it."""
    require_empty(shared(a, b, key), f"{key} on both sides")
    if within and shared(a, b, within).isEmpty():
        raise ContractError(f"the two sides share no {within}, so that their {key}s are disjoint shows nothing")


def split_lectures(manifest: DataFrame, group: str) -> DataFrame:
    """Q-05, A-26: groups (lectures, courses) that stand on both sides."""
    return manifest.groupBy(group).agg(F.count_distinct("split").alias("sides")).where("sides > 1")


def grouping_stats(rows: DataFrame, moment: str, lecture: str) -> DataFrame:
    """A-19, Q-06: moments, lectures, and moments per lecture."""
    m, n = F.count_distinct(moment), F.count_distinct(lecture)
    return rows.agg(m.alias("moments"), n.alias("lectures"), F.round(F.try_divide(m, n), 2).alias("moments_per_lecture"))


def require_grouping(rows: DataFrame, moment: str, lecture: str) -> None:
    stats = grouping_stats(rows, moment, lecture).first()
    if stats.moments > 1 and stats.moments == stats.lectures:
        raise ContractError("every moment is a lecture of its own: the lecture column doesn't group")


def coverage(asked: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """J-15, Q-08, U-08: keys on one side only, with the side."""
    a, b = asked.select(key).distinct().withColumn("asked", F.lit(True)), given.select(key).distinct().withColumn("given", F.lit(True))
    return a.join(b, key, "full_outer").where("asked IS NULL OR given IS NULL").select(key, F.when(F.col("asked").isNull(), "unasked").otherwise("unanswered").alias("fault"))


def require_scores(scored: DataFrame, columns: list[str]) -> None:
    """Q-12: every score within 0 and 1."""
    outside = " OR ".join(f"{c} < 0 OR {c} > 1" for c in columns)
    require_empty(scored.where(outside).select(*columns), "scores outside 0 to 1")


def require_deixis_reason(scored: DataFrame) -> None:
    """Q-13: deixis is left out only where it is stated that no pointer is drawn."""
    require_empty(scored.where("overall IS NOT NULL AND deixis IS NULL AND NOT (renders_cursor <=> false)").select("moment_id"), "deixis left out without a reason")


def require_pseudonyms(labels: DataFrame, rater: str) -> None:
    """Q-11: the message gives a number, never a name."""
    from lectio.functions.text import is_pseudonym

    n = labels.select(rater).distinct().where(~is_pseudonym(rater)).count()
    if n:
        raise ContractError(f"{n} rater names are no pseudonyms")


def rule_numbers(rules: DataFrame, book: DataFrame) -> DataFrame:
    """Q-09: rules in one of table and book only, or with numbers that differ."""
    t, b = rules.select("rule", F.col("number").alias("in_table")), book.select("rule", F.col("number").alias("in_book"))
    return t.join(b, "rule", "full_outer").where("NOT (in_table <=> in_book)")


def dangling_references(book: DataFrame, text: str = "text") -> DataFrame:
    """Q-10: rules named in a rule's text that don't exist."""
    named = book.select("rule", F.explode(F.regexp_extract_all(text, F.lit(r"\b([a-z]+(?:_[a-z]+)*_\d{3})\b"), F.lit(1))).alias("named")).distinct()
    return named.join(book.select(F.col("rule").alias("named")), "named", "left_anti")


def unfilled_placeholders(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Q-16, Q-17: prompts that still hold a placeholder."""
    return prompts.where(F.col(text).rlike(r"\{\{?\s*[a-z_]+\s*\}?\}"))


def exclusive_roles(models: DataFrame) -> DataFrame:
    """Q-15: models that judge pairs and metrics both."""
    return models.groupBy("model").agg(F.collect_set("role").alias("roles")).where("array_contains(roles, 'pair_judge') AND array_contains(roles, 'metric_judge')")
