"""Cleaning of a corpus for training: each stage reads the documents that the one before kept, as a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common, exact_dedup, packing, pii, quality, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. A null text is scored as an empty line; repeated rows and other columns stay; no documents give none."""
    field = quality.train(docs, common.table(spark, sf_dir, "labels"))
    names = common.fresh(docs.columns, "_score"), common.fresh(docs.columns, "_predicted")
    return quality.score(docs, field, score_col=names[0], predicted_col=names[1]).where(F.col(names[1]) == 1).drop(*names)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest identifier of each group of equal texts; a null text counts as empty, and of rows that share identifier and text one stays."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest identifier of each group of near duplicates: five-word shingles, 0.8 in common or more. Null identifiers and texts without words are no one's duplicates and stay."""
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows them. Null texts and null n_chars stay null, rows are neither dropped nor merged."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; a null or empty text is its end token alone, repeated rows are packed as often as they occur."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: SQL cannot express the classifier or the packing; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir; between two stages the documents are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"stage-{name}")
    return docs
