"""A training corpus from raw documents: five stages, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from quarry.llm.catalogue import fold
from quarry.llm.shared import free, small_batches, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def frugal(stage: Stage) -> Stage:
    """The stage in a session that hands rows to Python in small batches, as executors keep what the largest ones took through all stages."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@frugal
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; labels of fold 0 of 5 stay unseen, as in op1."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    return toxicity.rejected(docs, toxicity.fit(docs, labels))


@frugal
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand earlier; those of which nothing is left go, others get their new length."""
    removed = free(docs.columns, "removed")[0]
    out = line_dedup.dedup_lines(docs, removed=removed)
    cut = F.size(removed) > 0
    kept = out.filter(~cut | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn(
            "n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        )
    return kept.select(*docs.columns)


@frugal
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by 5-word shingles."""
    return near_dedup.without_copies(docs)


@frugal
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised."""
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    name = free(docs.columns, "held")[0]
    held = staged(found.select(F.col("doc_id").alias(name)).distinct(), "held")
    return docs.join(held, F.col("doc_id") == F.col(name), "left_anti")


@frugal
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Learnt scores, SimHash and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
