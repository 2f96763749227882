"""Image sources: NumPy files through Spark's binaryFile reader, and keyed array tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import tiff

_PIXELS = "path string, row long, col long, v double"


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """One row a pixel of every ``.npy`` or ``.tif`` image under <subject>/<region>/<modality>.* (O1, O2).

    An image that is not two-dimensional is an error.
    """

    def decode(batches):
        for batch in batches:
            for p, content in zip(batch.path, batch.content):
                image = tiff.decode(content) if p.endswith((".tif", ".tiff")) else np.load(io.BytesIO(content), allow_pickle=False)
                if image.ndim != 2:
                    raise ValueError(f"{p} has {image.ndim} dimensions, not 2")
                row, col = np.indices(image.shape)
                for at in range(0, image.size, 100_000):
                    cut = slice(at, at + 100_000)
                    yield pd.DataFrame({"path": p, "row": row.ravel()[cut], "col": col.ravel()[cut], "v": image.ravel()[cut].astype(float)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{npy,tif,tiff}").load(path)
    parts = F.split("path", "/")
    sample = F.concat_ws("__", F.element_at(parts, -3), F.element_at(parts, -2))
    modality = F.regexp_replace(F.element_at(parts, -1), r"\.\w+$", "")
    return files.select("path", "content").mapInPandas(decode, _PIXELS).select(sample.alias("sample_id"), modality.alias("modality"), "row", "col", "v")


def regions(spark: SparkSession, path: str, listed: DataFrame | None = None) -> DataFrame:
    """Sample ids found as folders, with those a file lists, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    found = files.select(F.concat_ws("__", F.element_at(parts, -3), F.element_at(parts, -2)).alias("sample_id"))
    return (found if listed is None else found.unionByName(listed.select("sample_id"))).distinct().orderBy("sample_id")


def write_keyed(rows: DataFrame, path: str) -> None:
    """Arrays by (sample_id, field), so that readers load only what they name."""
    rows.write.mode("overwrite").partitionBy("field", "sample_id").parquet(path)


def read_keyed(spark: SparkSession, path: str, field: str, samples: list[str] | None = None) -> DataFrame:
    """One field, of some samples: both filters prune folders."""
    df = spark.read.parquet(path).where(F.col("field") == field)
    return df if samples is None else df.where(F.col("sample_id").isin(samples))


def missing_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """All paths that do not exist, through the store's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            out.append(path)
    return out
