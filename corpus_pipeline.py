"""Training-corpus pipeline: quality rules, exact and near deduplication, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of docs.

Rows are judged as the operators say: a null or empty text fails the quality rules
and goes, with rows of few words; of texts equal but for the case of A-Z the row of
the largest id stays, null ids being least, and of rows equal in that too one; of a
near-duplicate group the row of the least id stays.  Very long texts are read whole.
Extra columns pass through all stages but the last, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm.common import documents, drop_path, materialize, release, told_of_tables
from lociq.llm.exact_dedup import exact_dedup
from lociq.llm.minhash import near_dedup
from lociq.llm.packing import pack
from lociq.llm.quality import quality_rules


#: Scratch tables that a thread's last stage on an input left, because its result read them.  When the next stage
#: begins, that result has been written and read again, so they go, unless the stage's docs still read them.
_LEFT: dict[tuple[str, int, str], list] = {}


def _stage(work):
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault((spark.sparkContext.applicationId, threading.get_ident(), sf_dir), [])
        release(spark, left, docs)
        with told_of_tables(left):
            return work(spark, docs, sf_dir)

    run_stage.work = work
    return run_stage


def _kept(docs: DataFrame, judged: DataFrame, at: int) -> DataFrame:
    """Rows whose verdict, the at-th column that the operator added, is true; docs' columns alone."""
    verdict = judged.columns[len(docs.columns) + at]
    return judged.filter(F.col(f"`{verdict}`")).select(*(F.col(f"`{c}`") for c in docs.columns))


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules(docs)
    return _kept(docs, judged, len(judged.columns) - len(docs.columns) - 1)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, exact_dedup(docs), 2)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, near_dedup(docs), 2)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]

#: The tokenizer and the fitted quality model cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  Each written result goes once its successor is written, with all scratch tables of its stage."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        made: list = []
        with told_of_tables(made):
            docs = materialize(stage.work(spark, docs, sf_dir), name)
        written = made.pop()
        release(spark, made, docs)
        if before is not None:
            drop_path(spark, before[0])
        before = written
    return docs
