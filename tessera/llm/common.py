"""What the ten operators share: the checkpoint folder, checked broadcasts, gapless numbering."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of every operator: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table that may be broadcast; a row here is at most a few hundred bytes.
BROADCAST_ROWS = 100_000
#: Rows that one numbering or selection bucket holds on average.
BUCKET_ROWS = 50_000
#: Buckets at least, so that a hot group is spread on small inputs too.
MIN_BUCKETS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where there is one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost executor costs one step."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str, folders: list[str]) -> DataFrame:
    """The same through Parquet, which is smaller than a checkpoint of rows, for large intermediate tables;
    the folder is noted in ``folders`` for ``discard``."""
    folders.append(new_folder(df.sparkSession, what))
    df.write.parquet(folders[-1])
    return df.sparkSession.read.schema(df.schema).parquet(folders[-1])


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes intermediate tables once a checkpoint of what was made from them is written."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint if ``df`` (cheap to count) has few rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets(rows: int) -> int:
    return max(MIN_BUCKETS, math.ceil(rows / BUCKET_ROWS))


def numbered(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each value of ``group`` (never null), without gaps.

    Rows are dealt to hash buckets inside the group, each bucket is numbered by itself and starts
    where the counts of the buckets before it end; no task sees a whole group.  ``df`` should be
    checkpointed: it is read for the count, the bucket counts and the numbering.
    """
    n = buckets(df.count())
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    sums = df.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, "_b").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        df.join(sums, [group, "_b"])
        .withColumn(out, (F.col("_base") + F.row_number().over(within) - 1).cast("long"))
        .drop("_b", "_base")
    )
