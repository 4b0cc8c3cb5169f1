"""Corpus pipeline: classifier, near-dedup, substring dedup, decontamination,
packing, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netweave.llm import decontaminate, neardup, packing, quality, substring_dedup
from netweave.llm.scratch import bounded_batches
from netweave.llm.token_files import vocabulary
from netweave.session import ensure_checkpoint_dir, scratch_path

#: Words of a near-dedup shingle, and similarity in hundredths.
SHINGLE, SIMILARITY = 5, 80


def _ready(spark: SparkSession) -> None:
    """The shared folder is known; texts go to Python a few megabytes at a time."""
    ensure_checkpoint_dir(spark)
    bounded_batches(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on them, does not reject."""
    _ready(spark)
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    _ready(spark)
    return neardup.keep_one(docs, SHINGLE, SIMILARITY)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that a smaller doc_id has too."""
    _ready(spark)
    return substring_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _ready(spark)
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 ids."""
    _ready(spark)
    return packing.pack(spark, packing.pieces(docs, vocabulary("word_bpe_49k.json"), end_id=0))


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup),
          ("substring_dedup", substring_deduplication), ("decontamination", decontamination),
          ("best_fit_packing", best_fit_packing)]
#: Training, components and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
