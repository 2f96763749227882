"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and read again as the next stage's ``docs``.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_copies, op1_mix, op5_resample, op6_passages, op8_pack
from tessera.llm.common import discard, new_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: documents that the sample leaves out go."""
    return op5_resample.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near copies, five-word shingles of similarity 0.8 or more: one document of each group stays."""
    return near_copies.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document of smallest id; what loses all its words goes.

    Of a changed document the words that are left are joined by blanks; others keep their text.
    """
    out = op6_passages.deduplicated(docs, True, docs.columns).where("_n_removed = 0 OR _n_removed < _n_words")
    changed = F.col("_n_removed") > 0
    new = {"text": F.col("_kept_text"), "n_chars": F.when(changed, F.length("_kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else out[c] for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pareto order sampling to the source targets: each document as often as it is taken."""
    return op1_mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Minimum bin slack: the pieces of all documents with their sequence and place."""
    return op8_pack.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

#: SQL can express neither the classifier nor the packing; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents of ``sf_dir``; a stage's table goes once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        discard(spark, before)
        docs, before = spark.read.parquet(folder), [folder]
    return STAGES[-1][1](spark, docs, sf_dir)
