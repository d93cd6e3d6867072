"""The rule book and its checks against the rule table (SRC-20, A-32, Q-09, Q-10, V-15, V-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
TAGS = ("DOC", "PROV")
ROUTES = ("mechanical", "judge", "penalty", "unscored")
RULE_ID = r"\b([a-z]+(?:_[a-z]+)*_\d{3})\b"
RULE_RANGE = r"\b([a-z]+(?:_[a-z]+)*)_(\d{3})\s*(?:\.\.|to|-|–)\s*(\d{3})\b"


def rule_book(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """SRC-20: (rule, tag, route, text, reviewed) from a book's parsed entries; texts are kept as they are."""
    rows = [(r["id"], r.get("tag"), r.get("route"), r.get("text"), bool(r.get("reviewed"))) for r in rules]
    return spark.createDataFrame(rows, "rule string, tag string, route string, text string, reviewed boolean")


def histogram(book: DataFrame, attribute: str) -> DataFrame:
    """A-32: rules per value of an attribute."""
    return book.groupBy(attribute).agg(F.count("*").alias("n"))


def book_faults(book: DataFrame) -> DataFrame:
    """Q-10: (rule, fault): ids defined twice, tags and routes outside the closed sets, empty texts, ids and ends of ranges cited but not defined."""
    text = F.coalesce("text", F.lit(""))
    named = lambda rows, fault: rows.select("rule", F.lit(fault).alias("fault"))
    repeated = book.groupBy("rule").agg(F.count("*").alias("n")).where("n > 1")
    found = named(repeated, "defined more than once")
    found = found.unionByName(named(book.where(~F.coalesce(F.col("tag").isin(*TAGS), F.lit(False))), "unknown tag"))
    found = found.unionByName(named(book.where(~F.coalesce(F.col("route").isin(*ROUTES), F.lit(False))), "unknown route"))
    found = found.unionByName(named(book.where(F.trim(text) == ""), "no text"))
    single = F.regexp_extract_all(text, F.lit(RULE_ID), F.lit(1))
    ends = F.zip_with(F.regexp_extract_all(text, F.lit(RULE_RANGE), F.lit(1)), F.regexp_extract_all(text, F.lit(RULE_RANGE), F.lit(3)), lambda family, last: F.concat(family, F.lit("_"), last))
    cited = book.select("rule", F.explode(F.array_distinct(F.concat(single, ends))).alias("cited"))
    dangling = cited.join(book.select(F.col("rule").alias("cited")).distinct(), "cited", "left_anti")
    return found.unionByName(dangling.select("rule", F.concat(F.lit("cites "), "cited").alias("fault")))


def table_faults(table: DataFrame, book: DataFrame) -> DataFrame:
    """Q-09: (rule, fault) where the table and the book differ, and numbers that aren't 1 to n."""
    both = table.select("rule", F.col("route").alias("of_table")).join(book.select("rule", F.col("route").alias("of_book")), "rule", "full")
    fault = F.when(F.col("of_table").isNull(), "only in the book").when(F.col("of_book").isNull(), "only in the table").when(F.col("of_table") != F.col("of_book"), "routes differ")
    numbers = table.groupBy("number").agg(F.min("rule").alias("rule"), F.count("*").alias("n"))
    gaps = numbers.join(F.broadcast(table.agg(F.count("*").alias("total")))).where("n > 1 OR number < 1 OR number > total")
    return both.select("rule", fault.alias("fault")).where("fault IS NOT NULL").unionByName(gaps.select("rule", F.lit("numbers aren't 1 to n").alias("fault")))


def summary(table: DataFrame, book: DataFrame) -> DataFrame:
    """V-16: one row: rules, by route, reviewed, and the faults found by Q-09 and Q-10."""
    counted = book.agg(F.count("*").alias("rules"), *[F.count_if(F.col("route") == r).alias(r) for r in ROUTES], F.count_if("reviewed").alias("reviewed"))
    faults = book_faults(book).unionByName(table_faults(table, book)).agg(F.count("*").alias("faults"))
    return counted.join(F.broadcast(faults))


def shared_prefix(task: str, book: list[str], principles: str) -> str:
    """V-15: the rules between a prompt's task and its principles."""
    return "\n\n".join([task.strip(), *(x.strip() for x in book), principles.strip()])
