"""From raw documents to packed training sequences: reject, deduplicate, mix, pack.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import mixing, packing, simhash, suffixes, toxicity
from gridloom.llm.common import remove, remove_at_exit, scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, calls toxic go."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All but the first occurrence of each repeated passage is cut; a document wholly cut goes."""
    return suffixes.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix; the order of the files and their rows carries it to the packing."""
    return mixing.order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences packed from runs of the mix, so that each stays as mixed as its surroundings: pieces and their bytes."""
    return packing.sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL: training, connected components and the packing's dynamic program; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents: sequences with their bytes, in order when sorted by (window, bin).

    Intermediate tables go to the cluster's shared folder. Each is deleted as soon as the next is written; the last, the
    mix, from which the result is read, goes when the session ends.
    """
    docs = table(spark, sf_dir, "documents")
    at, before = scratch(spark), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if before:
            remove(spark, before)
        before = f"{at}/{k}"
    remove_at_exit(spark, at)
    return STAGES[-1][1](spark, docs, sf_dir)
