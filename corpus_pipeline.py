"""The corpus pipeline: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectio.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from lectio.llm.common import documents, scope, unused, written

#: The tokenizer of the last stage: a parameter.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the word, repetition and compression limits."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's record speak for."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that others hold already."""
    return line_dedup.dedup_lines(docs, counts=tuple(unused(docs, "n_lines", "n_dropped"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("packing", packed)]
#: Compression, a fitted classifier, MinHash, SimHash and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage wrote on its way goes when its rows are written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scope():
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", stays=True)
    return docs
