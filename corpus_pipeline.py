"""A training corpus from ``documents``, by five operators one after the other.

``run`` hands each stage's rows to the next; a driver may also call the stages one by
one and write what each returns in between.

Every stage takes documents as the one before left them, with any further columns of any names, and all but the last
return the columns they were given.  Null and empty texts, and those without words, go in the first stage; what is
said of nulls, repeated rows, ties and very long texts stands at each operator.  An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, jaccard_join, language, mixing, passages
from colloquy.llm.session import cut, small_batches, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like no learned language, go."""
    small_batches(spark)
    return language.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document of the least id stays."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut out of the texts."""
    small_batches(spark)
    return passages.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out; documents that are mostly such words go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training blocks: (shard, slot, source, block, doc_ids, n_words, text)."""
    small_batches(spark)
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("passages", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: The permutations of the last stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
