"""Incremental builds: a step computes only the keys whose input rows have changed since it last ran.

A step is a function of the rows of a key.  Its folder holds generations (Parquet tables of what was computed in one
run) and numbered manifests that say for each key which content it was computed from and in which generation it lies.  A manifest
counts only once it is whole, and the last one that is whole is the state; an interrupted run leaves the state
before it.  Chained steps (regions, then their subjects, then regions again) follow by themselves: a step's output is
the next one's input, so a subject is computed again only if what its regions gave has changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Generations after which what still counts is written as one.
MANY = 20


def contents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _content: a digest of a key's rows whatever their order (their number, and two sums over their hashes)."""
    names = sorted(c for c in rows.columns if c not in keys)
    hashed = rows.select(*keys, F.xxhash64(*names, F.lit(1)).alias("_a"), F.xxhash64(*names, F.lit(2)).alias("_b"))
    sums = hashed.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.col("_a").cast("decimal(38,0)")).alias("_a"), F.sum(F.col("_b").cast("decimal(38,0)")).alias("_b"))
    return sums.select(*keys, F.concat_ws(":", "_n", "_a", "_b").alias("_content"))


class Build:
    """A folder of steps.  ``work`` tells how many keys each step computed in this run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.work = spark, root.rstrip("/"), {}

    def _manifests(self, step: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{step}/manifest-*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(s.getPath().getParent().toString() for s in found)

    def step(self, name: str, rows: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], version: str = "1") -> DataFrame:
        """What ``compute`` gives for the keys of ``rows`` (its output holds the key columns), new only for keys whose rows, or
        whose ``version``, are not those of the last run.  Keys that are gone from ``rows`` are gone from the result."""
        version = F.lit(version)
        now = contents(rows, keys).withColumn("_content", F.concat_ws("/", version, "_content"))
        manifests = self._manifests(name)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
        if manifests:
            old = self.spark.read.parquet(manifests[-1])
            joined = now.alias("n").join(old.alias("o"), [*same, F.col("n._content") == F.col("o._content")], "left")
            state = joined.select(*[F.col(f"n.{k}").alias(k) for k in keys], F.col("n._content").alias("_content"), F.col("o._generation").alias("_generation"))
        else:
            state = now.withColumn("_generation", F.lit(None).cast("string"))
        state = state.checkpoint()
        changed = state.where("_generation IS NULL").drop("_generation")
        self.work[name] = changed.count()
        folder = f"{self.root}/{name}"
        if self.work[name] or not manifests or state.count() != self.spark.read.parquet(manifests[-1]).count():
            generation = f"generation-{uuid.uuid4().hex}"
            some = changed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            # the same rows once more, and of them only those of changed keys
            part = rows.join(some, [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi")
            compute(part).write.parquet(f"{folder}/{generation}")
            whole = state.withColumn("_generation", F.coalesce("_generation", F.lit(generation)))
            whole.write.parquet(f"{folder}/manifest-{len(manifests):08d}")
        return self._load(name, keys)

    def _load(self, name: str, keys: list[str]) -> DataFrame:
        folder, manifests = f"{self.root}/{name}", self._manifests(name)
        state = self.spark.read.parquet(manifests[-1])
        generations = [r[0] for r in state.select("_generation").distinct().collect()]  # as many as runs, MANY at most
        out = None
        for generation in generations or [None]:
            path = f"{folder}/{generation}" if generation else sorted(self._generations(folder))[-1]
            part = self.spark.read.parquet(path).withColumn("_g", F.lit(generation))
            out = part if out is None else out.unionByName(part)
        kept = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_generation"))
        matches = [out[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        found = out.join(kept, [*matches, F.col("_g") == F.col("_generation")], "left_semi").drop("_g")
        if len(generations) > MANY:
            generation = f"generation-{uuid.uuid4().hex}"
            found.write.parquet(f"{folder}/{generation}")
            state.withColumn("_generation", F.lit(generation)).write.parquet(f"{folder}/manifest-{len(manifests):08d}")
            return self.spark.read.parquet(f"{folder}/{generation}")
        return found

    def _generations(self, folder: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/generation-*")
        return [s.getPath().toString() for s in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)]
