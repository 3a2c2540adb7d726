"""A corpus pipeline from four of the llm operators.

Documents in no learned language go, then those that fail the quality rules,
then all but one of each group of near duplicates; what is left is packed into
training sequences.  Each stage is written and read again by the next one; what a
stage wrote for itself is deleted when the next one begins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wireloom.llm import jaccard_join, language_id, packing, quality
from wireloom.tables import forgotten, table_count, tables_since, written

_LEFT: list[DataFrame] = []


def _stage(step):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # the stage before is written by now; should its rows still hang on its tables, they stay
        read = docs.inputFiles()
        if not any(t.written_at.split(":", 1)[-1] in f for t in _LEFT for f in read):
            forgotten(*(t for t in _LEFT if t.sparkSession.sparkContext is spark.sparkContext))
            _LEFT.clear()
        mark = table_count()
        out = step(spark, docs, sf_dir)
        _LEFT.extend(tables_since(mark))
        return out

    return run_stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", _stage(known_language)),
    ("quality_rules", _stage(good_quality)),
    ("ngram_jaccard_join", _stage(one_of_each_group)),
    ("packing", _stage(packed)),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
