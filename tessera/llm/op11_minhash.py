"""MinHash near-duplicates by b-bit signatures.

A text's set is its distinct lower-cased (A-Z) ``SHINGLE``-word shingles, as 64-bit hashes.  ``BANDS * ROWS`` multiply-add
functions each give the least value over the set (its minimum, 32 bits).  Two sketches are kept of them:

* a key a band: the hash of its ``ROWS`` whole minima.  Sets that share a key in some band are candidates; a
  pair of similarity 0.85 shares none with probability (1 - 0.85^6)^32, about 3e-7;
* the signature: the low ``BITS`` bits of every minimum, packed 32 to a long.  Of a candidate pair the equal
  places E are counted by bit counts.  Unequal minima agree by chance with C = 2^-BITS (the sets are tiny
  beside the 2^64 hashes), so the similarity is estimated as (E / n - C) / (1 - C).  Estimates more than
  ``SPREADS`` standard deviations under the threshold are dropped; all others are confirmed on the full sets.

Work is on distinct sets (nodes), so exact copies cost nothing, and no step grows with the square of a bucket:

1. in every bucket all are compared with the member that shares most;
2. buckets that hold several components after that are split by the rarest shingles of their members (a prefix
   filter over what is left, which loses no pair), and these pairs too go through the signature first.

Defined results: fewer words than ``SHINGLE`` are one shingle; null, empty and white-space texts have an empty
set (size 0), are linked with nothing, not even with each other, and name themselves; a null doc_id never names a
component unless all its members are null, and is then kept; repeated rows are copies of each other and each is
returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, stored, table
from tessera.llm.components import stars
from tessera.llm.near_copies import node, prefix_pairs, sets_of, shingles, similar

SHINGLE = 3
#: Least Jaccard similarity of a link, as a fraction of whole numbers.
SIMILARITY = (85, 100)
BANDS, ROWS, BITS = 32, 6, 2
#: Standard deviations of the estimate under the threshold that are still confirmed on full sets.
SPREADS = 6
_rng = random.Random(11)
_FACTORS, _SHIFTS = (np.array([_rng.getrandbits(64) | odd for _ in range(BANDS * ROWS)], np.uint64)[:, None] for odd in (1, 0))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose values under all functions are held at a time.
_BLOCK = 2048


def minima(found: np.ndarray) -> np.ndarray:
    """The least of the upper 32 bits under each function, in functions' order; ``found`` is not empty."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(found), _BLOCK):
        values = _FACTORS * found[None, at : at + _BLOCK]
        values += _SHIFTS
        np.minimum(out, values.min(axis=1), out=out)
    return out >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key a band, from whole minima; ``least`` is (sets, functions)."""
    keys = np.zeros((len(least), BANDS), np.uint64)
    for row in range(ROWS):
        keys = (keys ^ least[:, row::ROWS]) * _MIX
        keys ^= keys >> np.uint64(29)
    return ((keys + np.arange(BANDS, dtype=np.uint64)) * _MIX).view(np.int64)


def signatures(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` bits of each minimum, packed into longs, the first lowest."""
    per = 64 // bits
    low = (least & np.uint64((1 << bits) - 1)).reshape(len(least), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=2).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), node (hash of the set), size, keys (of the bands), sig."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, least = [], [], np.zeros((batch.num_rows, BANDS * ROWS), np.uint64)
            for i, text in enumerate(batch.column(2)):
                found = shingles(text.as_py(), SHINGLE)
                nodes.append(node(found))
                sizes.append(len(found))
                if len(found):
                    least[i] = minima(found)
            lists = [list(x) if n else [] for x, n in zip(band_keys(least), sizes)], [list(x) if n else [] for x, n in zip(signatures(least), sizes)]
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "h", "node", "size", "keys", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, node long, size long, keys array<long>, sig array<long>")


def estimate(one: Column, other: Column, bits: int = BITS, functions: int = BANDS * ROWS) -> Column:
    """Similarity of two sets from their signatures, corrected for chance agreement."""
    lanes = sum(1 << i for i in range(0, 64, bits))
    lanes -= (1 << 64) if lanes >> 63 else 0

    def unequal(x: Column) -> Column:
        either = x
        for shift in range(1, bits):
            either = either.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(either.bitwiseAND(F.lit(lanes)))

    differing = F.aggregate(F.zip_with(one, other, lambda a, b: unequal(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-bits
    return (1 - differing / functions - chance) / (1 - chance)


def least_estimate(similarity: tuple[int, int], bits: int = BITS, functions: int = BANDS * ROWS, spreads: float = SPREADS) -> float:
    """The smallest estimate that is still confirmed."""
    chance = 2.0**-bits
    agree = chance + (1 - chance) * similarity[0] / similarity[1]
    return similarity[0] / similarity[1] - spreads * math.sqrt(agree * (1 - agree) / functions) / (1 - chance)


def _likely(pairs: DataFrame, signed: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures (node, sig) may be of similar sets."""
    one, other = signed.select(F.col("node").alias("a"), F.col("sig").alias("x")), signed.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    return pairs.join(one, "a").join(other, "b").where(estimate(F.col("x"), F.col("y")) >= least_estimate(similarity)).select("a", "b")


def links(docs: DataFrame, distinct: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``distinct``: node, size, keys, sig, doc_id, h (checkpointed, no empty sets).  Node and root of what has near copies."""
    least, of = similarity
    folders: list[str] = []
    keyed = distinct.select("node", F.explode("keys").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("shared")).where("shared > 1")
    held = cut(keyed.join(shared, "bucket"))
    popular = held.groupBy("node").agg(F.sum(F.floor(1000 * F.log("shared"))).alias("popular"))
    members = cut(popular.join(distinct.select("node", "size", "sig"), "node"))
    signed = members.select("node", "sig")
    placed = held.join(members.select("node", "popular", "size"), "node")
    centres = cut(placed.groupBy("bucket").agg(F.max(F.struct("popular", "node", "size")).alias("c")))
    met = placed.join(centres, "bucket").where("node <> c.node").where(F.least("size", "c.size") * of >= F.greatest("size", "c.size") * least)
    met = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
    first = cut(_likely(met, signed, similarity))
    # buckets of two are settled by the first round
    wanted = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(held.where("shared > 2").select("node")).distinct()
    sets = stored(sets_of(docs, wanted.join(distinct.select("node", "doc_id", "h"), "node"), SHINGLE), "sets", folders)
    edges = cut(similar(first, sets, similarity))
    linked = stars(edges)
    rooted = placed.where("shared > 2").join(linked.withColumnRenamed("a", "node"), "node", "left")
    rooted = cut(rooted.select("bucket", "node", "size", F.coalesce("root", "node").alias("root")))
    # a bucket all of whose members are linked is done
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    left = cut(rooted.join(mixed, "bucket", "left_semi").select("node", "size", "root").distinct())
    rest = prefix_pairs(left, sets, folders, similarity).join(first, ["a", "b"], "left_anti")
    more = cut(similar(_likely(rest, signed, similarity), sets, similarity))
    discard(docs.sparkSession, folders)
    return linked if more.isEmpty() else stars(edges.unionByName(more))


def components(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id), kept."""
    marked = cut(sketches(docs))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("_row")
    distinct = marked.where("size > 0").groupBy("node").agg(least, *(F.first(c).alias(c) for c in ("size", "keys", "sig")))
    distinct = cut(distinct.select("node", "size", "keys", "sig", "_row.doc_id", "_row.h"))
    linked = links(docs, distinct, similarity)
    members = linked.select(F.col("a").alias("node"), "root").unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    members = cut(members.join(distinct.select("node", "doc_id"), "node"))
    smallest = members.groupBy("root").agg(F.min("doc_id").alias("low"))
    named = members.join(smallest, "root").select("node", "low")
    # cut, so that both sides of the last join are plain exchanges and a hot node can be split
    named = cut(distinct.join(named, "node", "left").select("node", F.coalesce("low", "doc_id").alias("low")))
    # empty sets, which name themselves, share one node: they stay out of the join's key
    key = F.when(F.col("size") > 0, F.col("node"))
    out = marked.select("doc_id", "size", key.alias("node")).join(named, "node", "left")
    out = out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
