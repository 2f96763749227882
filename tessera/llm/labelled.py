"""A bounded sample of labelled documents, the only rows that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Labelled rows that a fit uses at most.
SAMPLE_ROWS = 4000


def sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """label_id, quality, toxic, fold (0 or 1): the ``rows`` labelled documents of smallest hash."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    labels = labels.agg(F.min("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    labels = labels.orderBy(F.xxhash64("label_id", F.lit(5)), "label_id").limit(rows)
    return cut(labels.withColumn("fold", F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(2)).cast("int")))
