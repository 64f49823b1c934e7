"""Corpus pipeline: toxicity, line dedup, near duplicates, substring dedup, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of
``documents``, whatever further columns there are; a stage that changes a text also brings its
``n_chars`` up to date and drops the document if no word of it is left, as all of it stands
elsewhere. Null texts and those without a word pass every stage and pack as their end token; rows
that repeat come down to one in the near-duplicate stage; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import cut, fresh, small_batches
from matchloom.llm.lines import line_dedup
from matchloom.llm.near import near_dedup
from matchloom.llm.packing import packed_sequences
from matchloom.llm.registry import TOKENIZER
from matchloom.llm.substring import substring_dedup
from matchloom.llm.toxicity import drop_toxic


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """Python workers stay alive from stage to stage, beside a heap that the stages before have filled, so none gets many texts at once."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def _changed(out: DataFrame, count: str, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` of texts that changed and without texts that lost all their words."""
    hit = F.col(fresh(docs, count)) > 0
    left = out.where(~hit | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return left.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@_in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _changed(line_dedup(docs), "__n_deleted", docs)


@_in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


@_in_small_batches
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _changed(substring_dedup(docs), "__n_removed", docs)


@_in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_sequences(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup_stage),
    ("best_fit_packing", packing),
]

#: A trained classifier, hashing and packing aren't SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``; lineage is cut after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
