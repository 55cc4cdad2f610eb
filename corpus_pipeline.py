"""A corpus pipeline: toxicity, MinHash near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionloom.llm.common import Scratch, load
from motionloom.llm.decontaminate import decontaminate
from motionloom.llm.minhash import deduplicated
from motionloom.llm.mixing import mixed
from motionloom.llm.sharding import sharded
from motionloom.llm.toxicity import accepted, held_out, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows of this stage's input.

    Null and empty texts have the score of the intercept; repeated rows and ties are scored one by one; rows
    with null doc_ids are scored and not learnt from; without labels nothing is rejected but where all labels say
    so; an empty table gives no rows. Other columns pass."""
    labels = load(spark, sf_dir, "labels")
    return accepted(docs, train(docs, labels.where(~held_out("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (5 words, similarity 0.8): the smallest doc_id.

    Null, empty and blank texts are like nothing and stay; rows of one doc_id stay or go together; rows with null
    doc_ids stay; an empty table gives no rows. Other columns pass."""
    return deduplicated(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly benchmark go.

    Null, empty and wordless texts stay as they are; rows are judged one by one, so repeated rows, ties and null
    doc_ids are no special case; an empty table or benchmark changes nothing. Other columns pass."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null, empty and blank texts have no words and aren't taken; a null source is a source; repeated rows are
    units of their own, and of those at a limit as many are taken as come nearest; null doc_ids are drawn by their text; an
    empty table gives no rows. Other columns pass."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, as written and read back.

    Null and empty texts, null doc_ids and repeated rows are records like others; an empty table gives no rows. Other
    columns pass; a shard or slot column is replaced."""
    return sharded(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
