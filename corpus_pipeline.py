"""A training-data pipeline: documents in, packed training sequences out.

Each stage takes what the one before it kept and has its decisions take effect; all but the last return the
columns of documents. Stages that learn do so from the documents that they are given and `labels`.

Defined cases, in every stage: an empty table gives an empty one; columns beyond those of documents stay, whatever
their names; rows whose ids are null or repeat are judged one by one, each on its own text. A null or empty text
is scored by the classifier as an empty one; fails the base rules, which ask for 50 words; would be like nothing and
hold no benchmark item; and packs as its end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinbuild.llm import decontamination, near_dedup, packing, quality_classifier, quality_rules
from twinbuild.llm.common import stored

KEEP_FROM, METADATA = 0.7, ("n_chars",)  # as op5_quality predicts

ORACLE_SQL = None  # SQL can't express the trained stages


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    known = quality_classifier.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=METADATA)
    return quality_classifier.kept_by_quality(docs, known, KEEP_FROM, metadata=METADATA)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or that the isolation forest finds odd."""
    return quality_rules.kept_by_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return near_dedup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
