"""Run-length masks: ``"start length start length ..."``, 0-based, row-major."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(text: Column) -> Column:
    """Array of (start, len) in order of appearance."""
    numbers = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), lambda s: s.try_cast("long"))
    count = (F.size(numbers) / 2).cast("int")
    pick = lambda i: F.struct(F.get(numbers, 2 * i).alias("start"), F.get(numbers, 2 * i + 1).alias("len"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), pick)).otherwise(F.array().cast("array<struct<start:bigint,len:bigint>>"))


def from_positions(pixels: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Distinct positions to runs (keys, start, len): gaps and islands."""
    order = Window.partitionBy(*keys).orderBy(position)
    marked = pixels.select(*keys, position).distinct().withColumn("_island", F.col(position) - F.row_number().over(order))
    return marked.groupBy(*keys, "_island").agg(F.min(position).alias("start"), F.count("*").alias("len")).drop("_island")


def to_text(table: DataFrame, keys: list[str]) -> DataFrame:
    """Runs to one string a key."""
    pairs = F.array_sort(F.collect_list(F.struct("start", "len")))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat_ws(" ", p["start"].cast("string"), p["len"].cast("string"))), " ")
    return table.groupBy(*keys).agg(joined.alias("rle"))


def to_positions(table: DataFrame, keys: list[str]) -> DataFrame:
    """Runs to positions."""
    return table.select(*keys, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))


def problems(instances: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mask errors: odd count, not a number, empty or negative run, out of bounds, overlap in a mask set.

    ``instances``: sample_id, modality, cell_id, rle; ``sizes``: sample_id, modality, h, w.
    Returns sample_id, modality, cell_id, error.
    """
    keys = ["sample_id", "modality"]
    tokens = F.filter(F.split(F.trim("rle"), r"\s+"), lambda s: s != "")
    parsed = instances.withColumn("_t", tokens).withColumn("_bad", F.exists("_t", lambda s: s.try_cast("long").isNull()))
    form = parsed.select(*keys, "cell_id", F.when(F.size("_t") % 2 == 1, "odd").when(F.size("_t") == 0, "empty").when(F.col("_bad"), "number").alias("error")).where("error IS NOT NULL")
    spread = parsed.where("NOT _bad AND size(_t) % 2 = 0").select(*keys, "cell_id", F.inline(runs(F.col("rle")))).join(sizes, keys, "left")
    bounds = spread.select(*keys, "cell_id", F.when(F.col("len") <= 0, "length").when((F.col("start") < 0) | F.col("h").isNull() | (F.col("start") + F.col("len") > F.col("h") * F.col("w")), "bounds").alias("error")).where("error IS NOT NULL").distinct()
    order = Window.partitionBy(*keys).orderBy("start", "cell_id")
    ends = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    overlap = spread.where("len > 0").withColumn("_end", ends).where("start < _end").select(*keys, "cell_id", F.lit("overlap").alias("error")).distinct()
    return form.unionByName(bounds).unionByName(overlap)
