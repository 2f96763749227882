"""Sharding by Karmarkar-Karp differencing: near equal bytes with groups of equal texts kept whole.

The items are groups of equal texts; every one is differenced.  Groups are dealt by hash to parts of about ``PART_GROUPS``
groups; in each part, all parts at once, the two partial partitions of largest spread are combined
oppositely ordered until one is left.  The partial partitions of the parts, ``SHARDS`` sums each, are then combined by the same
rule on the driver, which never sees a group.  Documents find their shard by their group: large groups, at most
``LARGE`` of them, by a broadcast, so that a hot one stays where its rows are, the others by a join of narrow rows.

Defined results: a null text has one byte of size and is a group of its own (the empty text another);
repeated rows count each; an empty table gives no rows; slots number a shard's rows in no stated order;
other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, numbered, small, table

SHARDS = 16
PART_GROUPS = 20_000
#: A group of at least 1/LARGE of all bytes is large.
LARGE = 8192


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item."""
    return [s[0] for s in combined([(s, *[0] * (shards - 1)) for s in sizes])]


def combined(partitions: list[tuple[int, ...]]) -> list[list[int]]:
    """Combines partial partitions (sums, largest first) into one; for each, the final place of each of its sums."""
    if not partitions:
        return []
    shards = len(partitions[0])
    # a partition: its spread, its sums and, for each sum, a linked pair of member lists
    heap = [(p[-1] - p[0], i, p, tuple(range(i * shards, (i + 1) * shards))) for i, p in enumerate(partitions)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heap[0]
        both = sorted(((x + y, (p, q)) for x, y, p, q in zip(a, reversed(b), in_a, reversed(in_b))), key=lambda t: -t[0])
        sums, members = tuple(t[0] for t in both), tuple(t[1] for t in both)
        heapq.heapreplace(heap, (sums[-1] - sums[0], n, sums, members))
        n += 1
    out = [[0] * shards for _ in partitions]
    for shard, tree in enumerate(heap[0][3]):
        todo = [tree]
        while todo:
            at = todo.pop()
            if isinstance(at, tuple):
                todo += at
            else:
                out[at // shards][at % shards] = shard
    return out


def _differenced(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (_part, _group, _bytes), whole parts in a task: adds _local, the shard within the part,
    where 0 holds most bytes."""

    def one(ids: list[str], sizes: list[int]) -> list[int]:
        order = sorted(range(len(ids)), key=lambda i: (-sizes[i], ids[i]))
        found, sums = [0] * len(ids), [0] * shards
        for i, shard in zip(order, differencing([sizes[i] for i in order], shards)):
            found[i] = shard
            sums[shard] += sizes[i]
        place = {shard: k for k, shard in enumerate(sorted(range(shards), key=lambda k: (-sums[k], k)))}
        return [place[shard] for shard in found]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, sizes = None, [], []

        def done() -> pa.RecordBatch:
            columns = [pa.array([part] * len(ids), pa.int64()), pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(one(ids, sizes), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["_part", "_group", "_bytes", "_local"])

        for batch in batches:
            for p, g, n in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and ids:
                    yield done()
                    ids, sizes = [], []
                part = p
                ids.append(g)
                sizes.append(n)
        if ids:
            yield done()

    rows = groups.select("_part", "_group", "_bytes").repartition("_part").sortWithinPartitions("_part")
    return rows.mapInArrow(run, "_part long, _group string, _bytes long, _local int")


def assign(docs: DataFrame, shards: int = SHARDS, part_groups: int = PART_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), "null").otherwise(F.sha2(text, 256)).alias("_group"),
    )
    rows = cut(rows)
    groups = cut(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")))
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    parts = math.ceil(count / part_groups) or 1
    groups = cut(_differenced(groups.withColumn("_part", F.pmod(F.xxhash64("_group"), F.lit(parts))), shards))
    # a row a part and local shard: the sums of the partial partitions
    sums = {(r[0], r[1]): r[2] for r in groups.groupBy("_part", "_local").agg(F.sum("_bytes")).collect()}
    known = sorted({p for p, _ in sums})
    places = combined([tuple(sums.get((p, k), 0) for k in range(shards)) for p in known])
    final = spark.createDataFrame([(p, k, shard) for p, found in zip(known, places) for k, shard in enumerate(found)], "_part long, _local int, shard int")
    placed = groups.join(small(final, len(known) * shards), ["_part", "_local"]).select(F.col("_group").alias("_of"), "_bytes", "shard")
    large = F.broadcast(placed.where(F.col("_bytes") * LARGE >= total).select("_of", F.col("shard").alias("_shard")))  # at most LARGE rows
    rows = rows.join(large, F.expr("_group = _of"), "left").drop("_of")
    hot = rows.where("_shard IS NOT NULL").select("doc_id", "size", "text_crc32", F.col("_shard").alias("shard"))
    rest = rows.where("_shard IS NULL").join(placed.drop("_bytes"), F.expr("_group = _of")).select("doc_id", "size", "text_crc32", "shard")
    return numbered(cut(hot.unionByName(rest)), "shard", ["doc_id", "text_crc32", "size"], "slot")


def op3_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
