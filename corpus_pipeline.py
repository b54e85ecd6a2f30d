"""From raw documents to packed training sequences: five stages, each an operator of ``tidemark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written before the next stage is called and is
read again as its docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, exact_dedup, kneser_ney, mixing, near_copies, packing

_made: list[str] = []


def _stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Tables that the stage before staged go once its result is written, which is when the next stage is called."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _made)
        with common.recorded(_made):
            return make(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model rejects go."""
    return kneser_ney.accepted(docs, common.table(spark, sf_dir, "labels"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays. ``docs`` is the table that the stage before wrote, a plain read of files."""
    return exact_dedup.keep_last(docs, plain=True)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays. SimHash links and MinHash bands pick candidates."""
    return near_copies.one_of_each(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.emit(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("source mix", mix), ("packing", pack)]

#: Stages 1, 3 and 5 rest on a trained model, XXH64 shingles and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, make in STAGES:
        docs = common.stage(make(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
