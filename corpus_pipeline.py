"""From raw documents to packed sequences: poor texts, copies and near copies go, secrets are replaced, the rest is packed.

Every stage works on all rows its predecessor kept, and takes null, empty, very long and repeated texts as its operator
does: a null text counts as empty, of copies one row stays even if ids repeat or are null, rows with a null id are no
near copies, an empty table gives an empty table, and columns beyond those of documents are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from papyra.llm._shared import light_batches, scratch, table
from papyra.llm.exact_dedup import drop_exact_duplicates
from papyra.llm.packing import pack
from papyra.llm.quality import fit_quality, graded_labels, keep_quality
from papyra.llm.secrets_scan import redact_secrets
from papyra.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, fitted on the rated ones, gives the highest grade with probability 0.5 or more."""
    light_batches(spark)
    model = fit_quality(docs, graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return keep_quality(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps one row, that with the smallest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links connect, keeps the row with the smallest doc_id.

    Links are those of op8 (three words, 3 of 64 bits) and all of five-word shingles with a similarity of 0.8 or more.
    """
    light_batches(spark)
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, also encoded ones, by their kind; n_chars follows."""
    light_batches(spark)
    return redact_secrets(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its sequence of at most 1024 tokens and its place there."""
    light_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]
#: The classifier, the fingerprints' links and the packing are not expressible in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's own tables go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}", outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
