"""SimHash near-duplicates by covering locality-sensitive hashing.

A random map sends each of the 64 bits to a vector of F_2^(radius+1), every vector equally often.  For
each non-zero v of that space the mask a(v) holds bit i where <m(i), v> = 1.  Whatever ``radius`` bits
differ, some v is orthogonal to all their vectors, so two fingerprints within the radius agree on a(v)
and collide in table v: no link is missed.  Buckets work on distinct fingerprints:

* of two: compared in place by DataFrame functions;
* of up to ``PAIRWISE``: compared in blocks, and only a spanning forest of the links is returned;
* larger: two points are within 4 bits exactly if their balls of radius 2 meet, so each member stands
  for its 2081 ball points and is linked to the smallest member at each point; linear in the members.

Defined results: null, empty and white-space texts have fingerprint zero and are linked like any
other; a null doc_id never names a component unless all its members are null; repeated rows each get
the same answer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, small, table
from tessera.llm.components import stars

SHINGLE = 4
RADIUS = 4
SEED = 42
PAIRWISE = 6000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, highest bit first."""
    words = _WORD.findall(text.encode().lower()) if text else []  # bytes.lower: A-Z only
    if not words:
        return bytes(8)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
    n, counts, bits = len(starts), np.zeros(64, np.int64), np.frombuffer(hashes, np.uint8)
    for at in range(0, len(bits), 8 * 32_768):
        counts += np.unpackbits(bits[at : at + 8 * 32_768]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            raw = b"".join(fingerprint(t.as_py(), shingle, seed) for t in texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks as signed longs."""
    size = 1 << radius + 1
    vectors = [i % size for i in range(64)]
    random.Random(seed).shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links (member, smaller root) of the graph on ``members`` (distinct), by blocks of rows."""
    members = np.sort(members)
    bits, root = members.view(np.uint64), np.arange(len(members))
    todo = np.arange(len(members))  # not reached yet
    out = []
    while len(todo):
        start, todo = todo[0], todo[1:]
        front = np.array([start])
        while len(front) and len(todo):
            near = np.zeros(len(todo), bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(bits[front[at : at + 256], None] ^ bits[None, todo]) <= radius).any(axis=0)
            front, todo = todo[near], todo[~near]
            root[front] = start
            out += [(int(members[i]), int(members[start])) for i in front]
    return out


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (t, key, fp), dealt by (t, key) and sorted: links inside each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def links(block: np.ndarray, borders: np.ndarray) -> pa.RecordBatch:
            found = [pair for part in np.split(block, borders) for pair in forest(part, radius)]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1))
            block = np.concatenate(kept)
            borders = np.flatnonzero((np.diff(block[:, :2], axis=0) != 0).any(axis=1)) + 1
            last = borders[-1] if len(borders) else 0
            if last:
                yield links(block[:last, 2], borders[:-1])
            kept = [block[last:]]  # the last bucket may go on in the next batch; it holds few rows
        if kept and len(kept[0]):
            yield links(kept[0][:, 2], np.zeros(0, int))

    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long")


def _ball_links(members: DataFrame, radius: int) -> DataFrame:
    """Links among ``members`` (fp) by meeting points half the radius away; exact for even radius."""
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    assert radius == 4
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in flips])
    points = members.select("fp", F.explode(flips).alias("flip")).select("fp", F.expr("fp ^ flip").alias("point"))
    meet = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    return points.join(meet, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """``distinct``: fp (checkpointed).  Links a, b that connect what is within ``radius``."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])
    keyed = distinct.select("fp", F.posexplode(keys).alias("t", "key"))
    sizes = cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    two = sizes.where("n = 2").where(F.bit_count(F.expr("a ^ b")) <= radius).select("a", "b")
    found = sizes.agg(F.count_if(F.col("n") > 2), F.count_if(F.col("n") > pairwise)).first()
    out = two
    if found[0] > found[1]:
        some = small(sizes.where(F.col("n").between(3, pairwise)).select("t", "key"), found[0])
        out = out.unionByName(_bucket_links(keyed.join(some, ["t", "key"]).select("t", "key", "fp"), radius))
    if found[1]:
        many = small(sizes.where(F.col("n") > pairwise).select("t", "key"), found[1])
        out = out.unionByName(_ball_links(cut(keyed.join(many, ["t", "key"]).select("fp").distinct()), radius))
    return out


def components(docs: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE, **options) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    marked = cut(fingerprints(docs, **options))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = stars(links(distinct.select("fp"), radius, pairwise))
    members = linked.select(F.col("a").alias("fp"), "root").unionByName(linked.select(F.col("root").alias("fp"), "root").distinct())
    members = members.join(distinct, "fp")
    smallest = members.groupBy("root").agg(F.min("first_id").alias("low"))
    named = members.join(smallest, "root").select("fp", "low")
    # cut, so that both sides of the last join are plain exchanges and a hot fingerprint can be split
    named = cut(distinct.join(named, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id")))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def op9_covering_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
