"""A corpus pipeline out of the operators of paperloom.llm: rules, copies, near copies, mixture, sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), does its work on all
documents its predecessor kept, and returns documents; the last returns packed pieces. Stages are
written and read again in between, so each starts from files that no lost executor takes away.

Defined results: rows that repeat a doc_id with another text are documents of their own, and a null
doc_id is one like others; rows that repeat a doc_id and its text are copies, of which one stays;
rows that repeat a doc_id after the mixture are further copies of it and are packed each on their
own; an empty table passes through all stages; columns besides doc_id and text are carried along,
whatever their names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import common, exact_dedup, jaccard_join, mixing, packing, quality
from paperloom.session import delete, ensure_workers, own_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables in between of the last stage, by application: its result is read from them until it is written.
_LEFT: dict[str, list[str]] = {}


def stage(work: Stage, first: bool = False) -> Stage:
    """A stage begins when its predecessor's result is written, so it deletes what that one's tables in between still hold. The first one
    has no predecessor: the last stage of another run may not be written yet."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _LEFT.pop(app, [])
        for path in [] if first else left:
            delete(spark, path)
        with common.kept_tables() as made:
            try:
                return work(spark, docs, sf_dir)
            finally:
                _LEFT[app] = made

    return run


@functools.partial(stage, first=True)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the risk-controlled cutoffs of their language reject."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return exact_dedup.drop_copies(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles."""
    return jaccard_join.keep_one(docs)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the languages ask for."""
    return mixing.mixed(docs, mixing.languages(docs, common.table(spark, sf_dir, "labels")), mixing.TARGETS)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("mixing", mixture), ("packing", sequences)]

#: Classifiers, hashes and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ensure_workers(spark)
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        path = f"{own_folder(spark)}/{uuid.uuid4().hex}-{name}"
        made = step(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
