"""A corpus pipeline over documents: each stage works on all that the stage before it kept.

Every stage but the last takes and gives rows of COLUMNS. Null and empty texts go through all stages and end as a sequence
of the end token alone. doc_id names a document: if a row of an id is rejected, all rows of that id go. Rows without an id
are documents of their own that no stage can tell apart: they are scored, but never rejected, removed from or a source of
removals. Repeated rows of one id stay together. Very long texts are processed whole. Ties go to the smallest doc_id.
Columns of docs beyond COLUMNS are dropped by the first stage. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm._frames import written
from strataframe.llm.decontamination import decontaminate
from strataframe.llm.minhash_dedup import minhash_dedup
from strataframe.llm.packing import pack
from strataframe.llm.queries import table, tokenizer_path
from strataframe.llm.substring_dedup import substring_dedup
from strataframe.llm.toxicity import score_toxicity
from strataframe.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many rejected ids (8 bytes each) are broadcast to filter documents; beyond, the join shuffles.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for all rows whose doc_id is in rejected; rows without a doc_id stay."""
    rejected = written(rejected.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "rejected")
    rejected = F.broadcast(rejected) if rejected.count() <= BROADCAST_IDS else rejected
    return docs.join(rejected, "doc_id", "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    ship(spark)
    return without(docs, score_toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    ship(spark)
    return without(docs, minhash_dedup(docs).filter(~F.col("kept")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut; documents without one keep their text as it is."""
    ship(spark)
    found = substring_dedup(docs.withColumn("whole", F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("whole"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    ship(spark)
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    ship(spark)
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: The stages' classifier, hashes and tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
