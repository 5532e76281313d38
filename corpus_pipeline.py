"""A corpus pipeline: each stage takes all that its predecessor kept and, but for the last, returns the columns of
documents. A stage's result is written before the next stage begins, which then drops the working tables that the last
one left in the shared folder: a stage's result must not be read lazily across stages. Tables of other queries, and of
other runs, are never touched.

Null and empty texts fail the quality rules and go there, as do texts under ten words; rows that repeat are near copies
and one of them stays; ties go to the smaller doc_id, nulls last. Texts of any length are read whole. Further columns pass through all
stages but the last. An empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from albumweave.llm import jaccard, mixing, packing, perplexity, pii
from albumweave.llm.common import materialise, owned, release, table


_RUN: ContextVar[str] = ContextVar("run", default="stages")


def alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with working tables of its own run; those of the stage before it go."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _RUN.get())
        with owned(_RUN.get()):
            return stage(spark, docs, sf_dir)

    return run_stage


@alone
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return perplexity.passed(docs)


@alone
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.deduplicated(docs)


@alone
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets."""
    return pii.redact(docs)


@alone
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix takes them."""
    return mixing.repeated(docs)


@alone
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: SQL can't express the first, third and last stage; tests/llm/test_pipeline.py holds them all to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, table(spark, sf_dir, "documents"), sf_dir)


def applied(spark: SparkSession, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    """All stages on a table of documents."""
    token = _RUN.set(f"run-{uuid.uuid4().hex}")
    try:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name, working=False)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _RUN.reset(token)
