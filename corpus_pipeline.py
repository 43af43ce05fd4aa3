"""From raw documents to sampled training segmentations, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.llm import decontamination, near_dedup, quality_classifier, quality_rules, segmentation
from crawlspark.llm.queries import SENTENCEPIECE_MODEL, fitted_quality, table
from crawlspark.workspace import Scratch

#: SQL has no hinge-loss fit and no sampled lattice paths.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at half or more, learned from labels of the given documents."""
    columns = docs.columns
    scored = quality_classifier.with_quality(docs, fitted_quality(spark, docs, sf_dir))
    return scored.where("score >= 0.5").select(columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows that share a doc_id stand or fall together."""
    judged = quality_rules.judged(docs, table(spark, sf_dir, "labels"), Scratch(spark))
    return _without(docs, judged.where("not kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate component."""
    found = near_dedup.near_duplicates(docs, Scratch(spark))
    return _without(docs, found.where("not kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return _without(docs, decontamination.leaks(docs, table(spark, sf_dir, "benchmark")))


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document that is left, with inclusion scores."""
    return segmentation.sampled_segmentations(docs, segmentation.Vocabulary.load(SENTENCEPIECE_MODEL))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among the rejected ones; a null doc_id is rejected by a null."""
    ids = rejected.select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_rejected")), "left_anti")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("quality rules", apply_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece sampling", sample_segmentations),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept as a table in the shared folder."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{number}-{name.split()[0]}")
    return docs
